"""Spark session defaults and the shared scratch location.

Everything that must outlive one stage (stream checkpoints, materialised
snapshots) goes under ``spark.checkpoint.dir``, which a cluster points at
shared storage. Only when it is unset (local tests) do we make one.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

# Session settings that every job in the package assumes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE converts a sort-merge join to a broadcast join only when the
    # runtime size of one side is under this bound; otherwise the join
    # stays a shuffle join. This is the size check behind every join of a
    # data-sized table (cars, clients) in the package.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "carledger", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a private one only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        # A local session: one machine, so a folder of its own will do.
        # spark.checkpoint.dir cannot change at runtime, so only the
        # context's checkpoint folder is set (it adds a unique subfolder).
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="carledger-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    if root.startswith("file:"):
        root = root[len("file:"):]
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def files_state(spark: SparkSession, paths: list[str]) -> tuple:
    """(length, time) of each path's content: changes when a file does."""
    out = []
    for path in paths:
        fs, p = _hadoop(spark, path)
        out.append(tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))))
    return tuple(out)


#: Rows of the largest table for which a shuffle gets one more partition.
ROWS_PER_PARTITION = 250_000
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SIZED: dict[str, str] = {}      # application -> what size_shuffles set


def size_shuffles(spark: SparkSession, rows: int) -> int:
    """Let shuffles begin with a number of partitions that grows with the
    data (adaptive execution joins small ones), so that a task's rows do not;
    at least ``spark.sql.shuffle.partitions``. A number that the session was
    given stays. Returns the number."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-rows // ROWS_PER_PARTITION))
    app, given = spark.sparkContext.applicationId, spark.conf.get(INITIAL, None)
    if given is None or given == _SIZED.get(app):
        if n > least:
            _SIZED[app] = str(n)
            spark.conf.set(INITIAL, str(n))
        elif given is not None:
            spark.conf.unset(INITIAL)
    return n


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions of an explicit repartition: as many as a shuffle begins with."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL, None) or 0))


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``carledger`` importable in Python workers (as ``--py-files``
    would): zip the package once per application into the shared folder
    and register it with ``addPyFile``. Needed by the operators that run
    Python code on executors (the streamed change log)."""
    app = spark.sparkContext.applicationId
    with _SHIP_LOCK:
        if app not in _SHIPPED:
            _ship(spark)
            _SHIPPED.add(app)


def _ship(spark: SparkSession) -> None:
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    path = shared_path(spark, "pyfiles") + "/carledger.zip"
    if "://" in path:
        # addPyFile reads a driver-side file and serves it to executors;
        # the zip is only staged on the driver, no executor reads it there.
        local = tempfile.mkdtemp(prefix="carledger-zip-") + "/carledger.zip"
    else:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        local = path
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(local)
