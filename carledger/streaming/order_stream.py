"""H1 as a Structured Streaming job: order events in, history rows out.

Each order id is a state key (hash-partitioned on executors by
``groupBy('order_id')``); the state is the order's current row. Per
micro-batch, the events of one key are sorted by ``seq`` and folded:

* I: creates the order (skipped if it exists);
* U: writes the new row with the change note (skipped if no order);
  for a non-positive order id I and U change the state but write no row;
* D: writes the last row with status '1' and removes the state.

An event older than the last one its order has seen (a smaller ``seq``
that comes in a later micro-batch) is dropped: the log has rows for what
came after it already. So the state keeps the last seq of an order that is
closed (or never was there), until the watermark passes its last event.

The watermark follows the events' ``ts`` at a distance of ``late``. An event
at or behind it is dropped by Spark, so nothing that a forgotten order
would have refused can come any more: the state holds the open orders and
those that were closed within ``late``, however many orders there have been.
An order that is inserted anew after that time begins anew.

Output is append-only; history ids come from the events' ``seq``, so a
replayed micro-batch after a failure rewrites the same rows, and the file
sink's commit log keeps them exactly once. A micro-batch holds at most
``maxFilesPerTrigger`` files, so the source's file size bounds it, and a
group's events with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from carledger.functions.fixed import (
    NOTE_CAR_CHANGED, NOTE_CLIENT_CHANGED, NOTE_CREATED, NOTE_RENEWED, NOTE_RETURNED,
    STATUS_CLOSED, STATUS_OPEN,
)
from carledger.plans.joins import drop_shuffles
from carledger.schema import ORDER_EVENTS, ORDERS_HISTORY
from carledger.session import ship_package

STATE_SCHEMA = T.StructType([
    T.StructField("client_pass", T.StringType()),
    T.StructField("car_reg_num", T.StringType()),
    T.StructField("rented_at", T.TimestampNTZType()),
    T.StructField("returned_at", T.TimestampNTZType()),
    T.StructField("total_price", T.StringType()),   # exact decimal as text
    T.StructField("open", T.BooleanType()),
    T.StructField("last_seq", T.LongType()),
])
OUT_COLS = [f.name for f in ORDERS_HISTORY.fields]
VALS = ["client_pass", "car_reg_num", "rented_at", "returned_at"]


def _note(old: tuple, new: tuple) -> str | None:
    """Update note; later tests win as in the row trigger."""
    note = None
    if old[0] != new[0]:
        note = NOTE_CLIENT_CHANGED
    if old[3] != new[3]:
        note = NOTE_RENEWED
    if old[1] != new[1]:
        note = NOTE_CAR_CHANGED
    return note


def _ts(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def _dec(v):
    return None if v is None or (isinstance(v, float) and v != v) else Decimal(v)


def _millis(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


def fold_order_events(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold one order's events of a micro-batch (plain lists: the groups
    are small and many, so per-group pandas work would dominate)."""
    order_id = int(key[0])
    chunks = list(pdfs)
    if state.hasTimedOut:
        state.remove()
        return
    ev = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
    cols = {c: ev[c].tolist() for c in ("seq", "ts", "op", "client_pass", "car_reg_num", "rented_at",
                                        "returned_at", "total_price", "v_user")}
    order = sorted(range(len(cols["seq"])), key=cols["seq"].__getitem__)
    cur, last_seq = None, None
    if state.exists:
        c, r, rt, ret, tot, is_open, last_seq = state.get
        if is_open:
            cur = (c, r, _ts(rt), _ts(ret), _dec(tot))
    out = {c: [] for c in OUT_COLS}

    def emit(i, vals, status, note):
        out["id"].append(int(cols["seq"][i]))
        out["order_id"].append(order_id)
        out["changed_at"].append(cols["ts"][i])
        for name, v in zip(VALS + ["total_price"], vals):
            out[name].append(v)
        out["status"].append(status)
        out["note"].append(note)
        out["v_user"].append(cols["v_user"][i])

    for i in order:
        op = cols["op"][i]
        if last_seq is not None and cols["seq"][i] <= last_seq:
            continue          # older than what the log holds
        last_seq = int(cols["seq"][i])
        if op == "D":
            if cur is not None:
                emit(i, cur, STATUS_CLOSED, NOTE_RETURNED)
                cur = None
        elif op in ("I", "U"):
            if (op == "I") == (cur is not None):
                continue      # duplicate insert, or update of a missing order
            vals = (cols["client_pass"][i], cols["car_reg_num"][i], _ts(cols["rented_at"][i]),
                    _ts(cols["returned_at"][i]), _dec(cols["total_price"][i]))
            if order_id > 0:  # the guard skips logging, not the change
                emit(i, vals, STATUS_OPEN, NOTE_CREATED if op == "I" else _note(cur, vals))
            cur = vals
    if last_seq is not None:
        money = lambda d: None if d is None else str(d)
        state.update((None, None, None, None, None, False, last_seq) if cur is None
                     else (cur[0], cur[1], cur[2], cur[3], money(cur[4]), True, last_seq))
        if cur is None:
            last = max(_millis(t) for t in cols["ts"])
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
    if out["id"]:
        yield pd.DataFrame(out, columns=OUT_COLS)


BLOCK_STATE_SCHEMA = T.StructType([
    T.StructField("order_id", T.ArrayType(T.LongType())),
    T.StructField("client_pass", T.ArrayType(T.StringType())),
    T.StructField("car_reg_num", T.ArrayType(T.StringType())),
    T.StructField("rented_us", T.ArrayType(T.LongType())),
    T.StructField("returned_us", T.ArrayType(T.LongType())),
    T.StructField("total_cents", T.ArrayType(T.LongType())),
    T.StructField("open", T.ArrayType(T.BooleanType())),
    T.StructField("last_seq", T.ArrayType(T.LongType())),
    T.StructField("last_us", T.ArrayType(T.LongType())),
])
# Block output: money as integer cents; turned into decimal(10,2) by Spark.
BLOCK_OUT = T.StructType([f if f.name != "total_price" else T.StructField("total_cents", T.LongType())
                          for f in ORDERS_HISTORY.fields])
BLOCK_OUT_COLS = [f.name for f in BLOCK_OUT.fields]
VCOLS = ["client_pass", "car_reg_num", "rented_at", "returned_at", "total_cents"]


def _changed(a: pd.Series, b: pd.Series) -> pd.Series:
    """a <> b that is never true when either side is NULL."""
    return a.notna() & b.notna() & (a != b)


def _keep(state: GroupState, *columns: list) -> None:
    """The block's state without closed orders behind the watermark, and a
    call when the next of them falls behind it."""
    mark = state.getCurrentWatermarkMs()
    is_open, last_us = columns[6], columns[8]
    stays = [o or us // 1000 >= mark for o, us in zip(is_open, last_us)]
    if any(stays):
        state.update(tuple([v for v, s in zip(c, stays) if s] for c in columns))
        closed = [us // 1000 for o, us, s in zip(is_open, last_us, stays) if s and not o]
        if closed:
            state.setTimeoutTimestamp(min(closed) + 1)
    elif state.exists:
        state.remove()


def fold_block_events(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Same rules as ``fold_order_events`` for all orders of one hash block,
    vectorised: the state rows join the events as pseudo-events, existence
    before each event comes from the last insert/delete marker (an ignored
    duplicate insert or delete leaves the same state as an accepted one),
    and the last effective row's values are forward-filled per order. A
    closed order's state row stands as a delete, and only for its last seq;
    it goes when the watermark has passed the order's last event."""
    chunks = list(pdfs)
    if state.hasTimedOut or not chunks:
        _keep(state, *([list(c) for c in state.get] if state.exists else [[] for _ in BLOCK_STATE_SCHEMA]))
        return
    ev = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
    ev = ev[["seq", "ts", "op", "order_id", *VCOLS, "v_user"]]
    if state.exists:
        ids, cl, cr, rt, ret, tot, is_open, last, last_us = state.get
        ev = ev[ev["seq"] > ev["order_id"].map(dict(zip(ids, last))).fillna(-(2 ** 62))]
        st = pd.DataFrame({
            "seq": pd.Series(last, dtype="int64"), "ts": pd.to_datetime(pd.Series(last_us, dtype="int64"), unit="us"), "op": ["S" if o else "X" for o in is_open],
            "order_id": pd.Series(ids, dtype="int64"), "client_pass": cl, "car_reg_num": cr,
            "rented_at": pd.to_datetime(pd.Series(rt, dtype="Int64"), unit="us"),
            "returned_at": pd.to_datetime(pd.Series(ret, dtype="Int64"), unit="us"),
            "total_cents": pd.Series(tot, dtype="Int64"), "v_user": None})
        df = pd.concat([st, ev], ignore_index=True)
    else:
        df = ev.reset_index(drop=True)
    df["total_cents"] = df["total_cents"].astype("Int64")
    df = df.sort_values(["order_id", "seq"], kind="mergesort", ignore_index=True)
    oid, op = df["order_id"], df["op"]
    marker = op.where(op.isin(["I", "D", "S", "X"])).replace({"S": "I", "X": "D"})
    filled = marker.groupby(oid).ffill()
    exists_before = filled.groupby(oid).shift(1).eq("I")
    effective = (((op == "I") & ~exists_before) | (op.isin(["U", "D"]) & exists_before))
    valrow = (effective & op.isin(["I", "U"])) | (op == "S")
    ff = df[VCOLS].where(valrow).groupby(oid).ffill()
    prev = ff.groupby(oid).shift(1)

    out_rows = effective & ((op == "D") | (oid > 0))
    is_d = op == "D"
    note = pd.Series(None, index=df.index, dtype="object")
    upd = op == "U"
    note[upd & _changed(prev["client_pass"], df["client_pass"])] = NOTE_CLIENT_CHANGED
    note[upd & _changed(prev["returned_at"], df["returned_at"])] = NOTE_RENEWED
    note[upd & _changed(prev["car_reg_num"], df["car_reg_num"])] = NOTE_CAR_CHANGED
    note[op == "I"] = NOTE_CREATED
    note[is_d] = NOTE_RETURNED
    note = note.astype(object).where(note.notna(), None)
    vals = df[VCOLS].mask(is_d, prev)
    out = pd.DataFrame({
        "id": df["seq"], "order_id": oid, "changed_at": df["ts"],
        **{c: vals[c] for c in VCOLS},
        "status": is_d.map({True: STATUS_CLOSED, False: STATUS_OPEN}),
        "note": note, "v_user": df["v_user"],
    })[out_rows][BLOCK_OUT_COLS]

    last = df.groupby(oid, sort=False).tail(1).index
    is_open = filled.loc[last].eq("I")
    now = ff.loc[last].astype(object).where(is_open, None)
    if len(last):
        text = lambda c: [None if pd.isna(v) else v for v in now[c]]
        micros = lambda c: [None if pd.isna(v) else int(pd.Timestamp(v).value // 1000) for v in now[c]]
        _keep(state, oid.loc[last].astype("int64").tolist(), text("client_pass"), text("car_reg_num"),
              micros("rented_at"), micros("returned_at"),
              [None if pd.isna(v) else int(v) for v in now["total_cents"]], is_open.tolist(),
              df["seq"].loc[last].astype("int64").tolist(),
              [pd.Timestamp(t).value // 1000 for t in df["ts"].loc[last]])
    if len(out):
        yield out


ORDERS_PER_BLOCK = 1000


def blocks_for(orders: int, per_block: int = ORDERS_PER_BLOCK) -> int:
    """Number of blocks for so many orders."""
    return max(1, -(-orders // per_block))


#: How far events may come behind the latest one, and how long the state
#: remembers a closed order.
LATE = "30 days"


def change_log_stream(events: DataFrame, blocks: int | None = None, late: str = LATE) -> DataFrame:
    """Streaming DataFrame of history rows from a streaming event frame.

    ``blocks=None`` keys the state by order id (one Python call per order
    per micro-batch). ``blocks=n`` keys it by ``pmod(xxhash64(order_id), n)``
    so each call folds all events of one block; n must stay fixed for the
    life of a checkpoint, and grow with the number of orders
    (``blocks_for``: about ORDERS_PER_BLOCK in each).
    """
    ship_package(events.sparkSession)
    events = events.withColumn("_time", F.col("ts").cast("timestamp")).withWatermark("_time", late)
    if blocks is None:
        return events.groupBy("order_id").applyInPandasWithState(
            fold_order_events, ORDERS_HISTORY, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    keyed = (events.withColumn("_block", F.pmod(F.xxhash64("order_id"), F.lit(blocks)))
             .withColumn("total_cents", (F.col("total_price") * 100).cast("long")).drop("total_price"))
    out = keyed.groupBy("_block").applyInPandasWithState(
        fold_block_events, BLOCK_OUT, BLOCK_STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    money = (F.col("total_cents").cast("decimal(20,0)") / F.lit(100)).cast("decimal(10,2)")
    return out.select(*[money.alias(c) if c == "total_price" else F.col(c) for c in OUT_COLS])


#: State files that a stream keeps, unless the session says so: a query that
#: broke off goes on from the last micro-batch or the one before, and what a
#: task's state was changed by is joined to a whole after a few of them.
STATE_FILES = {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.stateStore.minDeltasForSnapshot": "3"}


def run_change_log(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                   max_files_per_trigger: int | None = None, blocks: int | None = None, late: str = LATE,
                   clean: bool = False):
    """Process every event file now in ``source_dir`` (availableNow) into a
    parquet history sink; returns the finished query. ``clean``: a file goes
    when the micro-batch that read it is done."""
    reader = spark.readStream.schema(ORDER_EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if clean:
        reader = reader.option("cleanSource", "delete")
    out = change_log_stream(reader.parquet(source_dir), blocks, late)
    own = [k for k in STATE_FILES if spark.conf.get(k, None) is None]
    for k in own:
        spark.conf.set(k, STATE_FILES[k])
    try:
        # A query keeps the settings that it began with.
        q = (out.writeStream.format("parquet").option("path", sink_dir).option("compression", "zstd")
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    finally:
        for k in own:
            spark.conf.unset(k)
    # The shuffle files of micro-batches that are done go while it runs.
    while not q.awaitTermination(60):
        drop_shuffles(spark)
    return q
