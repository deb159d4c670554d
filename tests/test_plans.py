"""Plan properties that must hold at any scale, checked on the smallest data:
no cartesian or nested-loop joins, no Python in batch queries, per-order
work on the stored history without a shuffle, filters reaching the scan."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
            "FlatMapGroupsInPandasWithState", "PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E
    out = {}
    for name, q in E.queries().items():
        if name == "order_change_stream" or re.fullmatch(r"op[0-9]+_.*|pipeline", name):
            continue
        out[name] = plan(q(spark, SF))
    return out


def test_no_cartesian_or_nested_loop(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert not bad


def test_batch_queries_stay_in_the_jvm(plans):
    bad = [n for n, p in plans.items() if any(x in p for x in PY_NODES)]
    assert not bad


def test_per_order_work_needs_no_shuffle(plans):
    for name in ("orders_changes", "order_change_log"):
        assert not re.search(r"Exchange (hash|range)partitioning", plans[name]), name


def test_filters_reach_the_scan(plans):
    assert re.search(r"PartitionFilters: \[[^\]]*status", plans["fin_report"])
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(type,PROMO\)", plans["find_car_by_type"])
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(returned_at", plans["expired_orders"])


def test_scans_prune_columns(plans):
    # fin_report reads only the columns it needs from the history
    m = re.search(r"ReadSchema: (struct<[^>]*>)", plans["fin_report"])
    assert m and "client_pass" not in m.group(1) and "note" not in m.group(1)
