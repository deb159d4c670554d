"""Rolling reports, logs of two versions, list pieces, exports read back and
checks of a batch, on the small fixture and on awkward values."""

from datetime import timedelta

import pytest
from conftest import D, M
from pyspark.sql import functions as F

from carledger import schema as S
from carledger.operators import history as H
from carledger.operators import quality as Q
from carledger.operators import reports as R
from carledger.operators.rolling import RollingReports
from carledger.session import shared_path
from carledger.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rolling_reports_equal_a_full_run(spark, fixture_tables):
    t = fixture_tables
    h, state = t["history"], RollingReports(spark, shared_path(spark, "rolling"))
    # A batch in the middle arrives twice, one is empty, an order spans two.
    for i, part in enumerate(["id <= 1", "id in (2, 5)", "id in (2, 5)", "id > 99", "id in (3, 4)"]):
        state.append({2: 1}.get(i, i), h.filter(part))
    small = state.compact(shared_path(spark, "compacted"))
    for s in (state, small):
        assert rows(s.orders_changes()) == rows(R.orders_changes(h))
        assert rows(s.orders_changes_report(t["orders"])) == rows(R.orders_changes_report(h, t["orders"]))
        assert rows(s.cars_report(t["cars"], "2024-01-21 00:00:00")) == rows(R.cars_report(h, t["cars"], "2024-01-21 00:00:00"))
    text = state.orders_changes()._jdf.queryExecution().executedPlan().toString()
    assert "note" not in text       # the state is read, not the history


def test_log_of_two_versions(spark):
    o = lambda i, car="k", ret=2, total=1, client="c": (i, client, car, D(1), D(ret), M(total))
    before = spark.createDataFrame([o(1), o(2), o(3), o(4), o(5), o(-1), o(-2)], S.ORDERS)
    after = spark.createDataFrame([o(1), o(2, car="x", ret=3), o(3, ret=4), o(4, total=9), o(-2, car="y"), o(7), o(-3)], S.ORDERS)
    got = rows(H.diff_log(before, after, F.lit("2024-02-01").cast("timestamp_ntz"), "U", 100)
               .select("id", "order_id", "car_reg_num", "status", "total_price", "note"))
    assert got == sorted([
        (102, 2, "x", "0", M(1), "client changed a car."), (103, 3, "k", "0", M(1), "client renewed a car."), (104, 4, "k", "0", M(9), None),
        (105, 5, "k", "1", M(1), "client returned a car."), (99, -1, "k", "1", M(1), "client returned a car."),
        (107, 7, "k", "0", M(1), "order was created.")], key=str)
    assert H.diff_log(before, before, F.current_timestamp().cast("timestamp_ntz"), "U").count() == 0


def test_pieces_of_car_lists(spark):
    h = [(i, i, D(1), "hot" if i % 3 else f"p{i % 7}", f"K{i * 7919 % 500:04d}", D(1), D(2), str(i % 2), M(i), None, "U") for i in range(600)]
    history = spark.createDataFrame(h, S.ORDERS_HISTORY).repartition(5)
    whole = {r.client_pass: r for r in R.client_report(history).collect()}
    parts = R.client_report_parts(history, 7).collect()
    assert {r.client_pass for r in parts} == set(whole)
    for c, w in whole.items():
        own = sorted((r for r in parts if r.client_pass == c), key=lambda r: r.part_no)
        assert [r.part_no for r in own] == list(range(own[0].parts)) and all(len(r.car_list.split(", ")) == 7 for r in own[:-1])
        assert ", ".join(r.car_list for r in own) == w.car_list and {(r.revenue, r.closed_revenue) for r in own} == {(w.revenue, w.closed_revenue)}


def test_export_keeps_values_and_order(spark):
    texts = ["plain", "a;b", "it's", "''", "'", "two\nlines", "cr\r\nlf", "", None, "tab\t", " blank ", "é;'\n'", '"', "\\", "-"]
    data = [(i, texts[i % len(texts)], M(i)) for i in range(400)]
    df = spark.createDataFrame(data, "k long, note string, m decimal(10,2)").repartitionByRange(5, "k").sortWithinPartitions("k")
    path = sinks.write_delimited(df, shared_path(spark, "csv"))
    back = {r.position: (r.k, r.note, r.m) for r in sinks.read_ordered(spark, path, df.schema).collect()}
    # An empty text is NULL; all else comes back as it was.
    assert back == {i: (k, n or None, m) for i, (k, n, m) in enumerate(data)}
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        sinks.read_ordered(spark, path, "k date, note string, m decimal(10,2)").count()


def test_export_in_many_files(spark):
    df = spark.range(1000).orderBy(F.desc("id"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "37")
    try:
        path = sinks.write_delimited(df, shared_path(spark, "csv"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    back = sinks.read_ordered(spark, path, df.schema).collect()
    assert all(r.position == 999 - r.id for r in back) and len(back) == 1000


def test_a_batch_is_checked_alone(spark, fixture_tables):
    t = fixture_tables
    end = D(20) + timedelta(hours=1)
    orders = spark.createDataFrame([
        (2, "1000000001", "A000000002", D(1), end, M(1)), (3, "1000000002", "none", D(1), end, M(1)), (4, None, "A000000004", D(1), end, M(1)),
        (5, "x", "A000000004", D(1), None, M(1)), (5, "1000000003", "A000000003", D(1), end, M(1))],
        "id long, client_pass string, car_reg_num string, rented_at timestamp_ntz, returned_at timestamp_ntz, total_price decimal(10,2)")
    extra = t["history"].filter("id in (1, 2)").withColumn("status", F.lit("7")).withColumn("v_user", F.lit("u" * 11))
    full = lambda o, h: {(r.table_name, r.rule): r.violations for r in
                         Q.constraint_violations(t["car_states"], t["cars"], t["clients"], o, h).collect()}
    before, after = full(t["orders"], t["history"]), full(t["orders"].union(orders), t["history"].unionByName(extra))
    got = {(r.table_name, r.rule): r.violations for r in
           Q.batch_violations(t["cars"], t["clients"], t["orders"], t["history"], orders, extra).collect()}
    assert got == {k: after[k] - before[k] for k in got} and sum(v > 0 for v in got.values()) == 9
    assert all(after[k] == before[k] for k in after if k not in got)
    none = Q.batch_violations(t["cars"], t["clients"], t["orders"], t["history"], orders.limit(0), extra.limit(0)).collect()
    assert {r.violations for r in none} == {0} and len(none) == len(got)
