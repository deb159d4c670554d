"""Delimited exports round-trip; the streamed change log equals the batch
log, survives a restart from its checkpoint and ignores replays."""

import os

import pytest

from pyspark.sql import functions as F

from carledger.operators import history as H
from carledger.schema import ORDERS_HISTORY
from carledger.session import shared_path
from carledger.sources import sinks
from carledger.streaming.order_stream import run_change_log


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_history_export_round_trip(spark, fixture_tables):
    p = shared_path(spark, "export-c")
    sinks.export_orders_history(fixture_tables["history"], p)
    back = sinks.read_delimited(spark, p)
    assert back.columns == ["id", "order id", "changed at", "client", "reg number of car", "rented at",
                            "returned at", "status", "total", "note", "v_user"]
    got = sorted((int(r["id"]), r["changed at"], r["status"], r["total"]) for r in back.collect())
    assert got[0] == (1, "05.01.24 00:00:00", "rented", "3000.00")
    assert got[3] == (4, "08.01.24 00:00:00", "returned", "3600.00")
    text = "".join(open(os.path.join(p, f)).read() for f in sorted(os.listdir(p)) if f.endswith(".csv"))
    assert "id;order id;changed at;client;" in text


def test_cars_export(spark, fixture_tables):
    p = shared_path(spark, "export-e")
    sinks.export_cars_history(fixture_tables["history"], fixture_tables["cars"], p)
    back = sinks.read_delimited(spark, p)
    got = sorted((r["car_reg_num"], r["order_id"], r["revenue"]) for r in back.collect())
    assert got == [("A000000001", "1", "4000.000000"), ("A000000001", "2", "2500.000000"),
                   ("A000000002", "1", "3200.000000")]


@pytest.mark.parametrize("blocks", [None, 3])
def test_stream_equals_batch_and_restarts(spark, fixture_tables, blocks):
    ev = H.events_from_history(fixture_tables["history"])
    src, sink, ckpt = (shared_path(spark, x) for x in ("ev", "sink", "ckpt"))
    ev.filter(F.col("op") == "I").write.parquet(f"{src}/wave=1")
    run_change_log(spark, f"{src}/*", sink, ckpt, blocks=blocks)
    # restart from the checkpoint with more events: state carries over
    ev.filter(F.col("op") != "I").write.parquet(f"{src}/wave=2")
    run_change_log(spark, f"{src}/*", sink, ckpt, blocks=blocks)
    # a rerun with nothing new adds nothing
    run_change_log(spark, f"{src}/*", sink, ckpt, blocks=blocks)
    streamed = spark.read.schema(ORDERS_HISTORY).parquet(sink)
    batch = H.order_change_log(ev)
    assert streamed.count() == 5
    assert rows(streamed) == rows(batch.select(*ORDERS_HISTORY.fieldNames()))


def test_guard_skips_logging_not_the_change(spark):
    """Order 0: insert and update are not logged, the delete is, with the
    values of the unlogged update; order 5 is logged normally."""
    from datetime import datetime
    from decimal import Decimal
    from carledger.schema import ORDER_EVENTS
    t = datetime(2024, 2, 1)
    d = Decimal("10.00")
    ev = spark.createDataFrame([
        (1, t, "I", 0, "c0", "car-a", t, t, d, "u"),
        (2, t, "U", 0, "c0", "car-b", t, t, Decimal("20.00"), "u"),
        (3, t, "D", 0, None, None, None, None, None, "u"),
        (4, t, "I", 5, "c5", "car-c", t, t, d, "u"),
    ], ORDER_EVENTS)
    want = [(3, 0, "car-b", "1", Decimal("20.00"), "client returned a car."),
            (4, 5, "car-c", "0", d, "order was created.")]
    got = sorted((r.id, r.order_id, r.car_reg_num, r.status, r.total_price, r.note)
                 for r in H.order_change_log(ev).collect())
    assert got == want
    for blocks in (None, 2):
        src, sink, ckpt = (shared_path(spark, x) for x in ("ev", "sink", "ckpt"))
        ev.write.parquet(src)
        run_change_log(spark, src, sink, ckpt, blocks=blocks)
        got = sorted((r.id, r.order_id, r.car_reg_num, r.status, r.total_price, r.note)
                     for r in spark.read.schema(ORDERS_HISTORY).parquet(sink).collect())
        assert got == want, blocks
