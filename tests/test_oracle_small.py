"""Every registered query against its DuckDB SQL on the smallest driver data."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"


def fleet_queries():
    """Those of the car rental; the training-data operators have tests of their own."""
    import __spark_entry__ as E
    return [q for q in E.queries() if not re.fullmatch(r"op[0-9]+_.*|pipeline", q)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_all_queries_match_duckdb(spark):
    from tools.check_oracle import compare
    res = compare(spark, SF, fleet_queries(), verbose=False)
    bad = {k: m for k, (ok, m) in res.items() if not ok}
    assert not bad, bad
    assert len(res) >= 35


def test_every_query_has_sql_or_is_declared():
    import __spark_entry__ as E
    missing = set(fleet_queries()) - set(E.oracle_sql())
    assert not missing, missing
