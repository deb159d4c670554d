"""Fleet rules, key checks and batch reject rules on the hand fixture."""

import hashlib

from conftest import D, M

from carledger import schema as S
from carledger.operators import commands as C
from carledger.operators import fleetops as FO
from carledger.operators import quality as Q


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_expired_and_quotes(spark, fixture_tables):
    t = fixture_tables
    left, hist = FO.expired_orders(t["orders"], "2024-01-13 00:00:00", "T", id_offset=1000)
    assert left.count() == 0
    assert rows(hist, "id", "order_id", "status", "total_price", "note") == [
        (1002, 2, "1", M(2500), "client returned a car.")]
    assert rows(FO.renew_quote(t["orders"], t["cars"]), "id", "returned_at", "total_price") == [
        (2, D(13, 12), M(3500))]
    swaps = spark.createDataFrame([(2, "A000000002", D(11))], "id long, car_reg_num string, ts timestamp_ntz")
    assert rows(FO.swap_quote(t["orders"], t["cars"], swaps), "id", "total_price") == [(2, M(2200))]


def test_close_early(spark, fixture_tables):
    t = fixture_tables
    closes = spark.createDataFrame([(9, D(11), 2)], S.ORDER_DELETES)
    res = FO.close_early(t["orders"], t["cars"], closes, "T")
    assert res.orders.count() == 0
    assert rows(res.cars.filter("reg_num = 'A000000001'"), "state_id") == [(1,)]
    assert rows(res.history, "id", "status", "total_price") == [(9, "1", M(2500))]


def test_pick_free_car(fixture_tables):
    seed = "s1"
    want = min(["A000000002", "A000000004"], key=lambda r: hashlib.md5((r + seed).encode()).hexdigest())
    assert [r.reg_num for r in FO.pick_free_car(fixture_tables["cars"], seed).collect()] == [want]


def test_constraint_violations(spark, fixture_tables):
    t = fixture_tables
    cars = t["cars"].unionByName(spark.createDataFrame([
        ("A000000001", 7, "x", "y", "z", M(1), D(1))], S.CARS))
    orders = t["orders"].unionByName(spark.createDataFrame([
        (3, "1000000002", "A000000009", D(10), D(11), M(1))], S.ORDERS))
    hist = t["history"].unionByName(spark.createDataFrame([
        (1, 1, D(5), "1000000001", "A000000001", D(5), D(8), "x", M(1), None, "U")], S.ORDERS_HISTORY))
    got = {(r.table_name, r.rule): r.violations
           for r in Q.constraint_violations(t["car_states"], cars, t["clients"], orders, hist).collect()}
    assert got[("cars", "pk_reg_num")] == 1
    assert got[("cars", "fk_state_id")] == 1
    assert got[("orders", "unique_client_pass")] == 1
    assert got[("orders", "fk_car_reg_num")] == 1
    assert got[("orders_history", "pk_id")] == 1
    assert got[("orders_history", "check_status")] == 1
    assert got[("clients", "pk_pass")] == 0 and got[("orders", "pk_id")] == 0
    assert got[("cars", "widths")] == got[("clients", "widths")] == got[("carstates", "not_null")] == 0
    assert len(got) == 20


def test_free_keys(spark, fixture_tables):
    cand = spark.createDataFrame([("1000000001",), ("1000000009",), (None,), ("1000000009",)], "pass string")
    assert rows(Q.free_keys(cand, fixture_tables["clients"], "pass", "pass"), "pass") == [("1000000009",)]


def test_add_orders_batch_rules(spark, fixture_tables):
    t = fixture_tables
    T = D(15)
    adds = spark.createDataFrame([
        (1, T, "1000000003", "A000000002", D(20)),   # accepted: 5 days x 800
        (2, T, "1000000001", "A000000002", D(20)),   # car already taken by call 1
        (3, T, "1000000002", "A000000004", D(20)),   # client has an open order
        (4, T, "1000000001", "A000000004", D(20)),   # accepted: call 2 failed, so ann is free
        (5, T, "9999999999", "A000000004", D(20)),   # unknown client
        (6, T, "1000000003", "NOPE000000", D(20)),   # unknown car
    ], S.ORDER_ADDS)
    res = C.add_orders(t["orders"], t["cars"], t["clients"], adds, "T", id_offset=100)
    assert rows(res.table.filter("id > 100"), "id", "client_pass", "total_price") == [
        (101, "1000000003", M(4000)), (104, "1000000001", M(10000))]
    assert rows(res.rejects, "seq") == [(2,), (3,), (5,), (6,)]
    assert rows(res.history, "id", "order_id", "note") == [(1, 101, "order was created."),
                                                          (4, 104, "order was created.")]


def test_client_verbs(spark, fixture_tables):
    t = fixture_tables
    dels = spark.createDataFrame([(1, D(15), "1000000002"), (2, D(15), "0000000000"),
                                  (3, D(15), "1000000003")], S.CLIENT_DELETES)
    res = C.delete_clients(t["clients"], dels, t["orders"])
    assert rows(res.table, "pass") == [("1000000001",), ("1000000002",)]
    assert rows(res.rejects, "seq", "err") == [(1, "err: pcrud.del_client")]
    adds = spark.createDataFrame([(1, D(15), "1000000001", "dup"), (2, D(15), "2000000000", "new"),
                                  (3, D(15), "2000000000", "again"), (4, D(15), "3000000000", None)],
                                 S.CLIENT_ADDS)
    res = C.add_clients(t["clients"], adds)
    assert rows(res.table.filter("pass >= '2'"), "pass", "name") == [("2000000000", "new")]
    assert rows(res.rejects, "seq") == [(1,), (3,), (4,)]
    ups = spark.createDataFrame([(1, D(15), "1000000001", "anna"), (2, D(15), "1000000001", None),
                                 (3, D(15), "7777777777", "x")], S.CLIENT_UPDATES)
    res = C.update_clients(t["clients"], ups)
    assert rows(res.table.filter("pass = '1000000001'"), "name") == [("anna",)]
    assert rows(res.rejects, "seq") == [(3,)]
