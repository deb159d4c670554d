"""Stored tables: layout (no shuffle for per-order work, status pruning)
and applying a verb's result (new table version + appended history)."""

import re

import pytest
from conftest import D, M

from carledger import schema as S
from carledger.operators import commands as C
from carledger.operators import reports as R
from carledger.sources.fleet_store import FleetStore, StoredFleetTables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_layout_and_apply(spark, fixture_tables):
    t = fixture_tables
    st = FleetStore.create(spark, t["cars"], t["clients"], t["history"], t["orders"], buckets=4)
    ft = StoredFleetTables(spark, "-", store=st)
    assert "Exchange" not in plan(R.orders_changes(ft.history))
    p = plan(R.fin_report(ft.history, "2024-01-01 00:00:00", "2024-01-31 00:00:00"))
    assert re.search(r"PartitionFilters: \[[^\]]*isnotnull(status".replace("(status", r"\(status"), p)
    cmds = spark.createDataFrame([(100, D(11), 2, "A000000002", None, None)], S.ORDER_UPDATES)
    st.apply(1, lambda b: C.update_orders(b.orders, b.cars, cmds, "T"), "orders")
    assert [(r.id, r.car_reg_num, r.total_price) for r in ft.orders.collect()] == [(2, "A000000002", M(2200))]
    h = ft.history
    assert h.count() == 6
    assert h.filter("id = 105").collect()[0].note == "client changed a car."
    ch = {r.order_id: r.changed_times for r in R.orders_changes(h).collect()}
    assert ch == {1: 4, 2: 2}


def test_batches_keep_ids_unique_and_can_be_repeated(spark, fixture_tables, monkeypatch):
    t = fixture_tables
    st = FleetStore.create(spark, t["cars"], t["clients"], t["history"], t["orders"], buckets=2)
    ft = StoredFleetTables(spark, "-", store=st)
    adds = spark.createDataFrame([(1, D(15), "1000000001", "A000000002", D(16)),
                                  (2, D(15), "1000000003", "A000000004", D(17))], S.ORDER_ADDS)
    add = lambda b: C.add_orders(b.orders, b.cars, b.clients, adds, "T", 100)
    # A crash between the two writes: nobody sees the half that is there.
    real = FleetStore._put

    def crash(self, name, *a):
        if name == "orders":
            raise RuntimeError("lost")
        real(self, name, *a)
    monkeypatch.setattr(FleetStore, "_put", crash)
    with pytest.raises(RuntimeError, match="lost"):
        st.apply(1, add, "orders")
    assert ft.history.count() == 5 and [r.id for r in ft.orders.collect()] == [2]
    monkeypatch.setattr(FleetStore, "_put", real)
    for _ in range(2):      # taken up, and once more by mistake
        st.apply(1, add, "orders")
        assert sorted(r.id for r in ft.orders.collect()) == [2, 101, 102] and ft.history.count() == 7
    first = {r.id: r.first_car for r in ft.orders_first_car.collect()}
    assert first == {2: "A000000001", 101: "A000000002", 102: "A000000004"}
    closes = spark.createDataFrame([(1, D(16), 101), (2, D(16), 102)], S.ORDER_DELETES)
    st.apply(2, lambda b: C.close_orders(b.orders, closes, "T"), "orders")
    ids = [r.id for r in ft.history.collect()]
    assert len(ids) == len(set(ids)) == 5 + 2 + 2
    assert [r.id for r in ft.orders.collect()] == [2]
    with pytest.raises(ValueError, match="not the last"):
        st.apply(1, add, "orders")


def test_a_journal_is_a_batch(spark, fixture_tables):
    from carledger.operators import journal as J
    t = fixture_tables
    st = FleetStore.create(spark, t["cars"], t["clients"], t["history"], t["orders"], buckets=2)
    ft = StoredFleetTables(spark, "-", store=st)
    calls = spark.createDataFrame([(1, D(15), "add_client", "N", "new", None, None, None), (2, D(15), "add_order", "N", None, "A000000004", None, D(16)),
                                   (3, D(15), "del_order", None, None, None, 2, None), (4, D(15), "del_car", None, None, "A000000002", None, None)],
                                  "seq long, ts timestamp_ntz, verb string, pass string, name string, reg_num string, id long, returned_at timestamp_ntz")
    for _ in range(2):
        st.apply(5, lambda b: J.apply_journal(b.cars, b.clients, b.orders, calls, b.car_states, "T", 100))
        assert [r.id for r in ft.orders.collect()] == [102] and ft.cars.count() == 3 and ft.clients.count() == 4 and ft.history.count() == 7


def test_lookups_read_the_buckets_of_their_keys(spark, fixture_tables):
    from carledger.operators import lookups as LK
    t = fixture_tables
    st = FleetStore.create(spark, t["cars"], t["clients"], t["history"], t["orders"], buckets=8)
    rows = lambda df: sorted(r.id for r in df.collect())
    by_client, by_car = st.layout("client_pass"), st.layout("car_reg_num")
    # Spark names the buckets in the plan only where it must keep them apart.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    one = LK.history_of(by_client, "client_pass", ["1000000002"])
    assert rows(one) == [5] and "SelectedBucketsCount: 1 out of 8" in plan(one)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    assert rows(LK.history_of(by_car, "car_reg_num", ["A000000002", "none"])) == [3, 4]
    keys = spark.createDataFrame([("1000000001",), ("1000000001",), (None,), ("x",)], "k string")
    st = FleetStore.create(spark, t["cars"], t["clients"], t["history"], t["orders"], buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = LK.history_for(st.layout("client_pass"), "client_pass", keys)
        p = plan(many)      # before it runs: only the keys are shuffled
        assert "Bucketed: true" in p and p.count("Exchange hashpartitioning(client_pass") == 1
        assert rows(many) == [1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    # A key with most of the rows is not put in one bucket.
    spark.conf.set("carledger.hotKeyRows", "1")
    try:
        st.layouts.clear()
        assert rows(LK.history_of(st.layout("client_pass"), "client_pass", ["1000000002"])) == [5]
        assert not st.bucket_layout["history_by_client"]
    finally:
        spark.conf.unset("carledger.hotKeyRows")


def test_hot_order_turns_bucketing_off(spark, fixture_tables):
    from pyspark.sql import functions as F
    t = fixture_tables
    h = t["history"]
    big = h.filter("id = 5").crossJoin(spark.range(1, 200).withColumnRenamed("id", "k")) \
        .withColumn("id", F.col("k") + 100).drop("k")
    spark.conf.set("carledger.hotKeyRows", "50")
    try:
        st = FleetStore.create(spark, t["cars"], t["clients"], h.unionByName(big), t["orders"], buckets=4)
    finally:
        spark.conf.unset("carledger.hotKeyRows")
    assert not st.bucket_history
    ft = StoredFleetTables(spark, "-", store=st)
    assert "Bucketed: true" not in plan(R.orders_changes(ft.history))
    assert {r.order_id: r.changed_times for r in R.orders_changes(ft.history).collect()} == {1: 4, 2: 200}


def test_shuffles_and_buckets_grow_with_the_rows(spark, monkeypatch):
    from carledger import session
    from carledger.sources import fleet_store
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 10)
    try:
        assert fleet_store._buckets(spark, 1000) == 100 == session.shuffle_parts(spark)
        assert fleet_store._buckets(spark, 5) == least == session.shuffle_parts(spark)
        spark.conf.set(session.INITIAL, "7")        # a number that the session was given stays
        fleet_store._buckets(spark, 1000)
        assert spark.conf.get(session.INITIAL) == "7"
    finally:
        spark.conf.unset(session.INITIAL)


def test_a_table_is_written_when_it_is_first_read(spark, tmp_path):
    d = str(tmp_path)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("part", [(i, "red blue", "b", "PROMO", 10.0 + i) for i in range(6)], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double")
    put("customer", [(1, "ann"), (2, "bob")], "c_custkey long, c_name string")
    put("orders", [(50, 2, "F", D(1)), (51, 1, "O", D(2))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")
    put("lineitem", [(o, n, n % 6, 0, 10.0 * n, 1.0, D(3), "A", "F", 0.0, 0.0) for o in (50, 51) for n in range(1, 8)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp_ntz, "
        "l_returnflag string, l_linestatus string, l_discount double, l_tax double")
    st = FleetStore.ingest(spark, d, buckets=3)
    t = StoredFleetTables(spark, d, store=st)
    assert t.cars.count() == 6 and set(st.pending) == {"clients", "history", "orders"}
    assert [r.id for r in t.orders.collect()] == [51] and set(st.pending) == {"clients"}
    # Lines 1 to 7: the car of an even line is that of the line before.
    rows = t.history.filter("order_id = 50").orderBy("id").collect()
    assert [int(r.car_reg_num[1:], 16) for r in rows] == [1, 1, 3, 3, 5, 5, 1]
    assert [r.client_pass[-1] for r in rows] == list("2221111") and rows[-1].status == "1"
    notes = ["order was created."]
    for old, new in zip(rows, rows[1:-1]):      # each note compares a row with the one before
        notes.append("client changed a car." if old.car_reg_num != new.car_reg_num else "client renewed a car." if old.returned_at != new.returned_at
                     else "client was changed." if old.client_pass != new.client_pass else None)
    assert [r.note for r in rows] == [*notes, "client returned a car."] and None not in notes[1:4]
    st.drop()


def test_stored_batches_write_the_history_once(spark, tmp_path, monkeypatch):
    """The tables stored anew are derived into their own store: nothing is
    written to the session's store first, to be copied from there."""
    from carledger import registry_stored as RS
    from carledger.sources.driver_tables import FleetTables
    d = str(tmp_path)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("part", [(i, "red blue", "b", "PROMO", 10.0 + i) for i in range(9)], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double")
    put("customer", [(i, f"c{i}") for i in range(1, 9)], "c_custkey long, c_name string")
    put("orders", [(i, i, "F" if i == 3 else "O", D(i)) for i in range(1, 9)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")
    put("lineitem", [(o, n, (o + n) % 9, 0, 10.0 * n, 1.0, D(3), "A", "F", 0.0, 0.0) for o in range(1, 9) for n in range(1, 1 + o % 4 + 1)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp_ntz, "
        "l_returnflag string, l_linestatus string, l_discount double, l_tax double")
    first, puts = [], []
    real_first, real_put = FleetStore._first, FleetStore._put
    monkeypatch.setattr(FleetStore, "_first", lambda self, name, *a, **k: first.append(name) or real_first(self, name, *a, **k))
    monkeypatch.setattr(FleetStore, "_put", lambda self, name, df, col, batch: puts.append((name, batch)) or real_put(self, name, df, col, batch))
    history = RS.QUERIES["stored_batches_history"](spark, d)
    # All four tables once, one batch, and another that comes twice.
    assert sorted(first) == ["cars", "clients", "history", "orders"]
    assert puts == [(n, b) for b in (1, 2, 2) for n in ("history", "orders")]
    own, rows = FleetTables(spark, d), history.collect()
    ids = [r.id for r in rows]
    assert len(ids) == len(set(ids)) and {r.id for r in own.history.collect()} < set(ids)
    closed = sorted(r.order_id for r in rows if r.status == "1")
    assert closed == [1, 2, 3, 5, 6, 7]     # 3 was closed before; 4 and 8 are not named by a call
    assert sorted(r.id for r in RS.QUERIES["stored_batches_orders"](spark, d).collect()) == [4, 8]


def test_calls_for_orders_read_them_once(spark, fixture_tables):
    from carledger.sources import driver_commands as DC
    t0 = D(1)
    o = spark.createDataFrame([(i, f"P{i}", f"K{i}", t0, D(9), M(1), f"F{i}") for i in range(1, 13)],
                              "id long, client_pass string, car_reg_num string, rented_at timestamp_ntz, returned_at timestamp_ntz, "
                              "total_price decimal(10,2), first_car string")
    for calls, scans in ((DC.order_updates(o), 1), (DC.order_deletes(o), 1)):
        assert len(re.findall(r"Scan ExistingRDD", plan(calls))) == scans and calls.count() == 36
    updates = {r.seq: r for r in DC.order_updates(o).collect()}
    assert (updates[60].car_reg_num, updates[65].car_reg_num, updates[69].id) == ("F6", "F6", -6)
    assert updates[70].car_reg_num is None and updates[75].returned_at == D(13) and updates[75].rented_at is not None
    deletes = sorted((r.seq, r.id) for r in DC.order_deletes(o).collect())
    assert deletes[:3] == [(13, 1), (14, 1), (15, -1)] and (43, -4) in deletes and (44, -4) in deletes
    # Of several closing calls the first counts; one without a number or an order closes nothing.
    more = spark.createDataFrame([(5, D(2), 1), (3, D(3), 1), (None, D(4), 2), (7, D(5), None), (8, D(6), 99)],
                                 "seq long, ts timestamp_ntz, id long")
    res = C.close_orders(o.drop("first_car"), more, "T")
    assert [(r.id, r.order_id, r.changed_at) for r in res.history.collect()] == [(3, 1, D(3))]
    assert res.table.count() == 11


def test_keys_are_counted_in_groups_first(spark):
    from carledger.plans import skew
    spark.conf.set("carledger.hotKeyRows", "50")
    try:
        few = spark.range(2000).selectExpr("id % 100 as k", "id as seq")
        assert skew.hot_keys(few, "k", "seq") is None
        hot = few.unionByName(spark.range(60).selectExpr("7L as k", "id + 5000 as seq"))
        assert [r.k for r in skew.hot_keys(hot, "k", "seq").collect()] == [7]
        from carledger.sources.fleet_store import has_hot_order
        assert has_hot_order(hot, "k", 100) and not has_hot_order(few, "k", 100)
    finally:
        spark.conf.unset("carledger.hotKeyRows")


def test_open_orders_alone_are_those_of_the_history(spark, tmp_path, monkeypatch):
    """A long history is not written for the open orders: the same rows come from the lines of orders that may be open,
    also where a status or a date is missing, an order comes twice or has no line."""
    from carledger.sources import fleet_store as FS
    d = str(tmp_path)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("part", [(i, "red blue", "b", "PROMO", 10.0 + i) for i in range(6)], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double")
    put("customer", [(i, f"c{i}") for i in range(9)], "c_custkey long, c_name string")
    put("orders", [(50, 2, "F", D(1)), (51, 1, "O", D(2)), (52, 3, None, D(3)), (53, 4, "P", D(4)), (53, 4, "P", D(4)), (54, 5, "O", D(5)), (54, 5, "O", D(5)),
                   (55, 6, "O", None), (56, 7, "O", D(6)), (None, 8, "O", D(6)), (100, 2, "O", D(7))],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")
    put("lineitem", [(o, n, (n + (o or 0)) % 6, 0, 10.0 * n, 1.0, D(3), "A", "F", 0.0, 0.0) for o in (50, 51, 52, 53, 54, 55, 100, None) for n in range(1, 2 + o % 7 if o else 3)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp_ntz, "
        "l_returnflag string, l_linestatus string, l_discount double, l_tax double")
    got = {}
    for most in (10 ** 6, 0):
        monkeypatch.setattr(FS, "ALONE_ROWS", most)
        st = FleetStore.ingest(spark, d, buckets=3)
        t = StoredFleetTables(spark, d, store=st)
        got[most] = sorted(map(tuple, t.orders_first_car.collect()), key=repr)
        assert ("history" in st.pending) == (most == 0)
        # The history itself, written later, is whole.
        assert {r.order_id for r in t.history.collect()} == {50, 51, 52, 53, 54, 55, 100}
        st.drop()
    assert got[0] == got[10 ** 6] and [r[0] for r in got[0]] == [100, 51, 52, 54, 55]
