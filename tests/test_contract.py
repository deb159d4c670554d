"""Driver contract: entry() on the smallest data, bench.py's JSON line."""

import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_entry_schema(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["reg_num", "orders_num", "clients_num", "total_revenue", "total_rented_time",
                          "days_since_service"]
    assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_bench_prints_one_json_line(tmp_path):
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_REPEAT="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=900)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout[-2000:] + out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["value"] > 0
    import __spark_entry__ as E
    assert set(d["queries"]) | set(d["stream_queries"]) | set(d["corpus_queries"]) == set(E.queries())
