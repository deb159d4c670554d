"""The files that the streamed change log reads and keeps."""

import glob
import os
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from carledger import params as P
from carledger import registry_more as RM
from carledger.operators import history as H
from carledger.schema import ORDERS_HISTORY
from carledger.streaming import order_stream as OS
from conftest import M


def _history(spark, orders):
    """Orders over three years, of three rows each; every other is closed."""
    out = []
    for i in range(1, orders + 1):
        at = datetime(2020 + i % 3, 1 + i % 12, 1 + i % 28)
        for k in range(3):
            out.append((i * 10 + k, i, at + timedelta(hours=k), f"{i:010d}", f"C{i + k:09d}", at, at + timedelta(days=3 + k),
                        "1" if k == 2 and i % 2 else "0", M(100 + i + k), None, "U"))
    return spark.createDataFrame(out, ORDERS_HISTORY)


def test_a_file_holds_whole_blocks_and_goes_when_read(spark, monkeypatch):
    monkeypatch.setattr(P, "STREAM_FILE_ROWS", 30)
    monkeypatch.setattr(P, "STREAM_BLOCK_ORDERS", 25)
    run, seen = OS.run_change_log, {}

    def watched(spark, source, sink, ckpt, **kw):
        block = F.pmod(F.xxhash64("order_id"), F.lit(kw["blocks"]))
        rows = spark.read.parquet(source).select(F.input_file_name().alias("f"), block.alias("b"), F.year("ts").alias("y"))
        seen.update(files=rows.select("f").distinct().count(), pairs=rows.select("f", "b").distinct().count(),
                    blocks=rows.select("b", "y").distinct().count(), most=rows.groupBy("f").count().agg(F.max("count")).first()[0],
                    source=source, ckpt=ckpt)
        q = run(spark, source, sink, ckpt, **kw)
        seen["left"] = len(glob.glob(f"{source}/*.parquet"))
        return q
    monkeypatch.setattr(OS, "run_change_log", watched)
    history = _history(spark, 200)
    got = RM._change_stream(SimpleNamespace(spark=spark, history=history))
    want = H.order_change_log(H.events_from_history(history)).select(*ORDERS_HISTORY.fieldNames())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # Only a block at the end of a file goes on in the next one.
    assert seen["files"] > 12 and seen["most"] <= 30
    assert seen["pairs"] <= seen["blocks"] + seen["files"]
    assert seen["left"] < seen["files"]
    assert not os.path.exists(seen["ckpt"]) and not glob.glob(seen["source"])


def test_few_state_files_are_kept(spark, tmp_path):
    """A state file for each task and micro-batch would grow with the input
    times its micro-batches. The session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in OS.STATE_FILES}
    ev = H.events_from_history(_history(spark, 60))
    for i in range(6):
        ev.filter(F.col("order_id") % 6 == i).coalesce(1).write.parquet(f"{tmp_path}/src/part={i}")
    OS.run_change_log(spark, f"{tmp_path}/src/*", f"{tmp_path}/sink", f"{tmp_path}/ckpt", 1, blocks=8, late="2000 days")
    assert {k: spark.conf.get(k, None) for k in OS.STATE_FILES} == before
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 180
    logs = glob.glob(f"{tmp_path}/ckpt/commits/[0-9]*")
    assert 2 <= len(logs) < 6
