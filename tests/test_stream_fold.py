"""The vectorised block fold equals the per-order fold on random, partly
malformed event streams (duplicate inserts, updates of missing orders,
events after a delete, non-positive ids), across two micro-batches."""

import random
from decimal import Decimal

import pandas as pd
import pytest

from carledger.streaming.order_stream import fold_block_events, fold_order_events


class FakeState:
    hasTimedOut = False

    def __init__(self):
        self.value, self.mark, self.wakes = None, 0, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, ms):
        assert ms > self.mark
        self.wakes = ms

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = tuple(v)

    def remove(self):
        self.value = None


def _events(rnd):
    rows, seq = [], 0
    t0 = pd.Timestamp("2024-06-01")
    for oid in list(range(-2, 1)) + list(range(1, 120)):
        for _ in range(rnd.randint(1, 8)):
            seq += 1
            op = rnd.choice("IIUUUD")
            rows.append({
                "seq": seq, "ts": t0 + pd.Timedelta(minutes=seq), "op": op, "order_id": oid,
                "client_pass": None if op == "D" else rnd.choice(["a", "b", "c"]),
                "car_reg_num": None if op == "D" else rnd.choice(["x", "y", "z"]),
                "rented_at": pd.NaT if op == "D" else t0,
                "returned_at": pd.NaT if op == "D" else t0 + pd.Timedelta(days=rnd.randint(1, 3)),
                "cents": None if op == "D" else rnd.randint(100, 99999),
                "v_user": "u"})
    rnd.shuffle(rows)
    return pd.DataFrame(rows)


def _order_frame(df):
    d = df.drop(columns=["cents"]).copy()
    d["total_price"] = [None if pd.isna(c) else Decimal(int(c)).scaleb(-2) for c in df["cents"]]
    return d


def _block_frame(df):
    d = df.rename(columns={"cents": "total_cents"}).copy()
    d["total_cents"] = d["total_cents"].astype("Int64")
    return d


def _norm(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("seed", [5, 6, 7, 8])
def test_block_fold_equals_order_fold(seed):
    rnd = random.Random(seed)
    ev = _events(rnd)
    cut = ev["seq"].median()
    batches = [ev[ev["seq"] <= cut], ev[ev["seq"] > cut]]

    per_order = []
    states = {}
    for b in batches:
        for oid, g in _order_frame(b).groupby("order_id"):
            st = states.setdefault(oid, FakeState())
            for out in fold_order_events((oid,), iter([g]), st):
                for r in out.itertuples(index=False):
                    per_order.append((r.id, r.order_id, r.status, r.note, r.client_pass, r.car_reg_num,
                                      pd.Timestamp(r.returned_at), int(r.total_price * 100)))

    block = []
    st = FakeState()
    for b in batches:
        for out in fold_block_events((0,), iter([_block_frame(b)]), st):
            for r in out.itertuples(index=False):
                block.append((int(r.id), int(r.order_id), r.status, r.note, r.client_pass, r.car_reg_num,
                              pd.Timestamp(r.returned_at), int(r.total_cents)))

    assert len(per_order) > 100
    assert _norm(block) == _norm(per_order)


@pytest.mark.parametrize("hot", [None, "3"])
def test_batch_log_equals_order_fold(spark, hot):
    """The window-based batch change log follows the same rules on
    malformed events, on the plain and on the hot-order split path."""
    from carledger.operators import history as H
    from carledger.schema import ORDER_EVENTS
    ev = _events(random.Random(9))
    per_order = []
    for oid, g in _order_frame(ev).groupby("order_id"):
        for out in fold_order_events((oid,), iter([g]), FakeState()):
            for r in out.itertuples(index=False):
                per_order.append((int(r.id), int(r.order_id), r.status, r.note, r.client_pass, r.car_reg_num,
                                  pd.Timestamp(r.returned_at), int(r.total_price * 100)))
    o = _order_frame(ev)
    rows = [(int(r.seq), r.ts.to_pydatetime(), r.op, int(r.order_id), r.client_pass, r.car_reg_num,
             None if pd.isna(r.rented_at) else r.rented_at.to_pydatetime(),
             None if pd.isna(r.returned_at) else r.returned_at.to_pydatetime(), r.total_price, r.v_user)
            for r in o.itertuples(index=False)]
    if hot:
        spark.conf.set("carledger.hotKeyRows", hot)
    try:
        got = H.order_change_log(spark.createDataFrame(rows, ORDER_EVENTS)).collect()
    finally:
        spark.conf.unset("carledger.hotKeyRows")
    batch = [(r.id, r.order_id, r.status, r.note, r.client_pass, r.car_reg_num, pd.Timestamp(r.returned_at),
              int(r.total_price * 100)) for r in got]
    assert _norm(batch) == _norm(per_order)


def _order(oid, seq, day, op):
    t = pd.Timestamp("2024-01-01") + pd.Timedelta(days=day)
    gone = op == "D"
    return {"seq": seq, "ts": t, "op": op, "order_id": oid, "client_pass": None if gone else "c", "car_reg_num": None if gone else "k",
            "rented_at": pd.NaT if gone else t, "returned_at": pd.NaT if gone else t, "cents": None if gone else 5, "v_user": "u"}


def test_block_state_forgets_closed_orders():
    st, sizes = FakeState(), []
    for wave in range(10):
        rows = [_order(100 * wave + i, 1000 * wave + i, 10 * wave, "I") for i in range(20)]
        rows += [_order(100 * wave + i, 1000 * wave + 500 + i, 10 * wave + 1, "D") for i in range(19)]
        st.mark = (pd.Timestamp("2024-01-01") + pd.Timedelta(days=10 * wave - 15)).value // 10 ** 6 if wave else 0
        list(fold_block_events((0,), iter([_block_frame(pd.DataFrame(rows))]), st))
        sizes.append(len(st.get[0]))
        assert st.wakes is not None
    # One order of each wave stays open; closed ones are those of two waves.
    assert sizes == [20, 40] + [41 + k for k in range(8)]
    st.mark, st.hasTimedOut = (pd.Timestamp("2025-01-01")).value // 10 ** 6, True
    list(fold_block_events((0,), iter([]), st))
    assert len(st.get[0]) == 10 and all(st.get[6])


@pytest.mark.parametrize("blocks", [None, 2])
def test_stream_state_stays_flat(spark, blocks):
    """Waves of orders that open and close: the state does not grow, and an
    event that comes too late is dropped, not taken for a new order."""
    from carledger.schema import ORDER_EVENTS, ORDERS_HISTORY
    from carledger.session import shared_path
    from carledger.streaming.order_stream import run_change_log
    src, sink, ckpt = (shared_path(spark, x) for x in ("ev", "sink", "ckpt"))
    plain = lambda v: None if v is None or pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    kept, want = [], 0
    for wave in range(5):
        rows = [_order(10 * wave + i + 1, 100 * wave + i, 10 * wave, "I") for i in range(6)]
        rows += [_order(10 * wave + i + 1, 100 * wave + 50 + i, 10 * wave + 1, "D") for i in range(6)]
        want += 12
        if wave == 4:
            rows.append(_order(1, 10_000, 0, "I"))       # 40 days late, of an order that is forgotten
        rows = [(r["seq"], plain(r["ts"]), r["op"], r["order_id"], r["client_pass"], r["car_reg_num"], plain(r["rented_at"]),
                 plain(r["returned_at"]), None if r["cents"] is None else Decimal(r["cents"]), "u") for r in rows]
        spark.createDataFrame(rows, ORDER_EVENTS).coalesce(1).write.parquet(f"{src}/wave={wave}")
        q = run_change_log(spark, f"{src}/*", sink, ckpt, blocks=blocks, late="5 days")
        kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.schema(ORDERS_HISTORY).parquet(sink).count() == want
    assert max(kept[1:]) <= (12 if blocks is None else 2), kept


def test_registered_stream_uses_large_blocks():
    from carledger import params
    from carledger.streaming.order_stream import blocks_for
    assert blocks_for(9_000_000, params.STREAM_BLOCK_ORDERS) == 1125
