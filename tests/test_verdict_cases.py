"""Keys and ids without a size limit, first valid calls, empty texts, late
stream events, even pieces of hot keys."""

import pandas as pd
import pytest
from conftest import D, M
from pyspark.sql import functions as F

from carledger import schema as S
from carledger.operators import commands as C
from carledger.plans import skew
from carledger.session import checkpoint_root
from carledger.sources import driver_tables as DT
from carledger.streaming.order_stream import blocks_for, fold_block_events, fold_order_events
from test_stream_fold import FakeState, _block_frame, _order_frame


def test_keys_are_lossless(spark):
    big = [0, 7, 10 ** 9, 10 ** 9 + 1, 12345678901, 16 ** 9 - 1]
    rows = spark.createDataFrame([(k,) for k in big], "k long")
    cars = [r[0] for r in rows.select(DT.car_key(F.col("k"))).collect()]
    clients = [r[0] for r in rows.select(DT.client_key(F.col("k"))).collect()]
    assert len(set(cars)) == len(set(clients)) == len(big) and all(len(k) == 10 for k in cars + clients)
    for k in (16 ** 9, -1):
        with pytest.raises(Exception, match="cannot hold"):
            spark.createDataFrame([(k,)], "k long").select(DT.car_key(F.col("k"))).collect()


def test_long_orders_keep_their_ids(spark):
    rows = spark.createDataFrame([(o, n) for o in (1, 2) for n in range(1, 151)], "o long, n int")
    assert rows.select(DT.line_id(F.col("o"), F.col("n"))).distinct().count() == 300
    with pytest.raises(Exception, match="too many lines"):
        spark.createDataFrame([(1, DT.LINES)], "o long, n int").select(DT.line_id(F.col("o"), F.col("n"))).collect()


def one_by_one(keys, calls, valid):
    taken, out = set(keys), []
    for c in sorted(calls):
        if valid(c) and c[2] not in taken:
            taken.add(c[2])
            out.append(c[0])
    return out


def test_first_valid_call_wins(spark, fixture_tables):
    calls = [(1, D(2), "N1", "red", "m", "t", None), (2, D(2), "N1", "red", "m", "t", M(5)), (3, D(2), "N1", "red", "m", "t", M(6)),
             (4, D(2), "N2", "", "m", "t", M(5)), (5, D(2), "N2", "blue", "m", "t", M(7)), (6, D(2), "A000000001", "x", "m", "t", M(1)),
             (7, D(2), "", "x", "m", "t", M(1))]
    res = C.add_cars(fixture_tables["cars"], spark.createDataFrame(calls, S.CAR_ADDS))
    want = one_by_one([r.reg_num for r in fixture_tables["cars"].collect()], [c for c in calls if c[2]],
                      lambda c: c[3] and c[6] is not None)
    assert want == [2, 5]
    assert sorted(r.seq for r in res.rejects.collect()) == [c[0] for c in calls if c[0] not in want]
    assert {r.reg_num: r.price for r in res.table.collect() if r.reg_num[0] == "N"} == {"N1": M(5), "N2": M(7)}
    adds = [(1, D(2), "9", ""), (2, D(2), "9", "bob"), (3, D(2), "9", "carl")]
    res = C.add_clients(fixture_tables["clients"], spark.createDataFrame(adds, S.CLIENT_ADDS))
    assert [r.name for r in res.table.filter("pass = '9'").collect()] == ["bob"]


def test_empty_text_keeps_the_value(spark, fixture_tables):
    t = fixture_tables
    upd = spark.createDataFrame([(1, D(2), "1000000001", "")], S.CLIENT_UPDATES)
    assert [r.name for r in C.update_clients(t["clients"], upd).table.filter("pass = '1000000001'").collect()] == ["ann"]
    upd = spark.createDataFrame([(1, D(2), "A000000001", None, "", "vw", "", None, None)], S.CAR_UPDATES)
    r = C.update_cars(t["cars"], upd, t["car_states"]).table.filter("reg_num = 'A000000001'").first()
    assert (r.color, r.mark, r.type) == ("red", "vw", "sedan")


def test_late_events_are_dropped():
    at = pd.Timestamp("2024-06-01")
    event = lambda seq, op, car: {"seq": seq, "ts": at, "op": op, "order_id": 7, "client_pass": "a", "car_reg_num": car,
                                  "rented_at": at, "returned_at": at, "cents": 100, "v_user": "u"}
    batches = [[event(1, "I", "x"), event(3, "U", "z")], [event(2, "U", "y")], [event(5, "D", None)], [event(4, "I", "w")],
               [event(6, "I", "v")]]
    order, block, a, b = FakeState(), FakeState(), [], []
    for rows in batches:
        df = pd.DataFrame(rows)
        for out in fold_order_events((7,), iter([_order_frame(df)]), order):
            a += list(zip(out["id"], out["car_reg_num"], out["status"]))
        for out in fold_block_events((0,), iter([_block_frame(df)]), block):
            b += list(zip(out["id"].astype(int), out["car_reg_num"], out["status"]))
    assert a == b == [(1, "x", "0"), (3, "z", "0"), (5, "z", "1"), (6, "v", "0")]
    assert blocks_for(1) == 1 and blocks_for(2001) == 3


def test_hot_pieces_are_even(spark):
    rows = spark.range(20000).selectExpr("1 as k", "id as seq").union(spark.createDataFrame([(1, 10 ** 12), (2, 5)], "k int, seq long"))
    spark.conf.set("carledger.hotKeyRows", "1000")
    try:
        hot = skew.hot_keys(rows, "k", "seq")
        cold, warm = skew.split(rows, "k", "seq", hot)
        sizes = [r["count"] for r in warm.groupBy(skew.PIECE).count().collect()]
        many = spark.range(30000).selectExpr("id % 10 as k", "id as seq")
        assert skew.hot_keys(many, "k", "seq").count() == 10
    finally:
        spark.conf.unset("carledger.hotKeyRows")
    assert cold.count() == 1 and sum(sizes) == 20001 and max(sizes) <= 1200


def test_no_private_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())
