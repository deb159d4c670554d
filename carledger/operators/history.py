"""H1: the order change log.

Every insert, update and delete of an open order becomes one history row.
An update's note compares the new row with the order's previous row; later
tests win, so the precedence is: created > car changed > renewed (any
change of returned_at) > client changed > NULL. A delete writes the
order's last values with status '1'.

Batch form: one window per order ordered by ``seq`` (``lag``), so the
whole log is one hash shuffle on ``order_id`` plus a sort inside each
partition. The streaming form (``carledger.streaming``) keeps the last row
per order in state instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carledger.plans import skew as S
from carledger.functions.fixed import (
    NOTE_CAR_CHANGED, NOTE_CLIENT_CHANGED, NOTE_CREATED, NOTE_RENEWED, NOTE_RETURNED,
    STATUS_CLOSED, STATUS_OPEN,
)

HISTORY_COLS = ["id", "order_id", "changed_at", "client_pass", "car_reg_num", "rented_at",
                "returned_at", "status", "total_price", "note", "v_user"]
VALUE_COLS = ["client_pass", "car_reg_num", "rented_at", "returned_at", "total_price"]


def change_note(old_client, old_car, old_returned, new_client, new_car, new_returned) -> Column:
    """Note of an update; a NULL old value never counts as a change."""
    return (F.when(old_car != new_car, F.lit(NOTE_CAR_CHANGED))
            .when(old_returned != new_returned, F.lit(NOTE_RENEWED))
            .when(old_client != new_client, F.lit(NOTE_CLIENT_CHANGED)))


def events_from_history(history: DataFrame) -> DataFrame:
    """Order events whose log reproduces a history table: seq = id; the
    first row of an order is an insert, a later closed row a delete, any
    other row an update. The first id per order is an aggregate joined
    back (partial aggregation), not a window over the order."""
    first = history.groupBy("order_id").agg(F.min("id").alias("_first"))
    h = history.join(first, "order_id")
    op = (F.when(F.col("id") == F.col("_first"), F.lit("I"))
          .when(F.col("status") == STATUS_CLOSED, F.lit("D"))
          .otherwise(F.lit("U")))
    return h.select(
        F.col("id").alias("seq"), F.col("changed_at").alias("ts"), op.alias("op"), "order_id",
        *VALUE_COLS, "v_user")


def _op(name: str) -> Column:
    return F.col("op") == name


def _flags(exists_before: Column) -> tuple[Column, Column]:
    """(effective, value row): an insert of a missing order or an update /
    delete of an existing one takes effect; inserts and updates that take
    effect carry the order's new values."""
    eff = (_op("I") & ~exists_before) | ((F.col("op").isin("U", "D")) & exists_before)
    return eff, eff & F.col("op").isin("I", "U")


def _prev_plain(ev: DataFrame) -> DataFrame:
    """Per event: did the order exist before it (last insert/delete marker,
    an ignored duplicate leaves the same state), and the values of the last
    effective insert/update before it. One window partitioning throughout."""
    w = Window.partitionBy("order_id").orderBy("seq")
    wb = w.rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("_m", F.when(F.col("op").isin("I", "D"), F.col("op")))
    ev = ev.withColumn("_exists", F.coalesce(F.last("_m", True).over(wb) == "I", F.lit(False)))
    eff, val = _flags(F.col("_exists"))
    ev = ev.withColumn("_eff", eff).withColumn("_val", val)
    return ev.select("*", *[F.last(F.when(F.col("_val"), F.col(c)), True).over(wb).alias(f"_prev_{c}")
                            for c in VALUE_COLS])


def _prev_split(ev: DataFrame) -> DataFrame:
    """The same for hot orders cut into seq-range pieces: each piece starts
    from the last marker and the last effective values of earlier pieces."""
    k = ["order_id", S.PIECE]
    wb = Window.partitionBy(*k).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("_m", F.when(F.col("op").isin("I", "D"), F.col("op")))
    ev = ev.join(S.carry_last_given(ev, "order_id", "seq", ["_m"]), k, "left")
    last_m = F.coalesce(F.last("_m", True).over(wb), F.col("_carry._m"))
    ev = ev.withColumn("_exists", F.coalesce(last_m == "I", F.lit(False))).drop("_carry")
    eff, val = _flags(F.col("_exists"))
    ev = ev.withColumn("_eff", eff).withColumn("_val", val)
    pv = [f"_pv_{c}" for c in VALUE_COLS]
    ev = ev.select("*", *[F.when(F.col("_val"), F.col(c)).alias(p) for c, p in zip(VALUE_COLS, pv)])
    ev = ev.join(S.carry_last_given(ev, "order_id", "seq", pv), k, "left")
    ev = ev.select("*", *[F.coalesce(F.last(p, True).over(wb), F.col(f"_carry.{p}")).alias(f"_prev_{c}")
                          for c, p in zip(VALUE_COLS, pv)])
    return ev.drop("_carry", S.PIECE, *pv)


def _log_rows(ev: DataFrame) -> DataFrame:
    prev = {c: F.col(f"_prev_{c}") for c in VALUE_COLS}
    vals = {c: F.when(_op("D"), prev[c]).otherwise(F.col(c)) for c in VALUE_COLS}
    note = (F.when(_op("D"), F.lit(NOTE_RETURNED))
            .when(_op("I"), F.lit(NOTE_CREATED))
            .otherwise(change_note(prev["client_pass"], prev["car_reg_num"], prev["returned_at"],
                                   F.col("client_pass"), F.col("car_reg_num"), F.col("returned_at"))))
    # Only effective events write rows; the guard (order id > 0) of the
    # insert/update trigger skips logging, not the change, so a later
    # delete of such an order is logged with its unlogged last values.
    keep = F.col("_eff") & (_op("D") | (F.col("order_id") > 0))
    return ev.filter(keep).select(
        F.col("seq").alias("id"), "order_id", F.col("ts").alias("changed_at"),
        *[vals[c].alias(c) for c in VALUE_COLS[:4]],
        F.when(_op("D"), F.lit(STATUS_CLOSED)).otherwise(F.lit(STATUS_OPEN)).alias("status"),
        vals["total_price"].alias("total_price"),
        note.alias("note"), "v_user",
    )


def order_change_log(events: DataFrame, split_hot: bool = True) -> DataFrame:
    """History rows for a batch of order events, with the same rules as the
    streamed log: an insert of an existing order, or an update or delete of
    a missing one, changes nothing and writes no row. Inserts and updates
    of a non-positive order id change the order but write no row (the
    guard of the insert/update trigger); its delete is logged.

    Orders with very many events (``plans.skew.hot_keys``) are cut into
    seq-range pieces scanned in parallel; the rest use one window."""
    ev = events
    hot = S.hot_keys(ev, "order_id", "seq") if split_hot else None
    if hot is None:
        return _log_rows(_prev_plain(ev))
    cold, warm = S.split(ev, "order_id", "seq", hot)
    return _log_rows(_prev_plain(cold)).unionByName(_log_rows(_prev_split(warm)))


def history_rows(rows: DataFrame, status: str, note: Column | str | None,
                 changed_at: Column, v_user: str, id_col: Column) -> DataFrame:
    """History rows for order rows (id, client_pass, ...) changed by a command."""
    n = note if isinstance(note, Column) else F.lit(note).cast("string")
    return rows.select(
        id_col.cast("long").alias("id"), F.col("id").cast("long").alias("order_id"),
        changed_at.alias("changed_at"), *VALUE_COLS[:4], F.lit(status).alias("status"),
        "total_price", n.alias("note"), F.lit(v_user).alias("v_user"))


def diff_log(before: DataFrame, after: DataFrame, changed_at: Column, v_user: str, id_offset: int = 0) -> DataFrame:
    """History rows for what differs between two versions of the open
    orders: an order that came, one whose values changed (compared
    null-safe), one that went (its last values, status '1'). An order gives
    at most one row, with id ``id_offset`` + order id; orders with a
    non-positive id are logged only when they go (the trigger's guard)."""
    old, new = (df.select("id", F.struct(*VALUE_COLS).alias(n)) for df, n in ((before, "_old"), (after, "_new")))
    j = old.join(new, "id", "full_outer")
    came, went = F.col("_old").isNull(), F.col("_new").isNull()
    differs = came | went | ~F.col("_old").eqNullSafe(F.col("_new"))
    j = j.filter(differs & (went | (F.col("id") > 0)))
    note = (F.when(came, F.lit(NOTE_CREATED)).when(went, F.lit(NOTE_RETURNED))
            .otherwise(change_note(*[F.col(f"{v}.{c}") for v in ("_old", "_new") for c in ("client_pass", "car_reg_num", "returned_at")])))
    vals = F.coalesce(F.col("_new"), F.col("_old"))
    return j.select(
        (F.lit(id_offset) + F.col("id")).cast("long").alias("id"), F.col("id").cast("long").alias("order_id"), changed_at.alias("changed_at"),
        *[vals[c].alias(c) for c in VALUE_COLS[:4]], F.when(went, F.lit(STATUS_CLOSED)).otherwise(F.lit(STATUS_OPEN)).alias("status"),
        vals["total_price"].alias("total_price"), note.alias("note"), F.lit(v_user).alias("v_user"))
