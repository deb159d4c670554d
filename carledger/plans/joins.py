"""Join strategies with their size reasoning written down.

* ``with_state_name``: the state table is a fixed 3-row dimension, so a
  broadcast is bounded by construction.
* Data-sized dimensions (``cars``, ``clients``) are joined with a plain
  equi-join. With AQE on, Spark measures the finished shuffle stage and
  switches to a broadcast join only if that side is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond it the join
  stays a sort-merge join, and AQE splits skewed partitions
  (``spark.sql.adaptive.skewJoin.enabled``). No hint forces a broadcast of
  a table whose size grows with the data.
* The hot-key table of ``plans.skew`` is a written table and joined like
  any other.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_state_name(df: DataFrame, car_states: DataFrame) -> DataFrame:
    """Left join of the state name (3-row table, broadcast)."""
    s = car_states.select(F.col("id").alias("state_id"), "state")
    return df.join(F.broadcast(s), "state_id", "left")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written under the shared checkpoint folder):
    used where one intermediate feeds several branches or outputs, so the
    join chain before it runs once and a lost executor costs a re-read,
    not a recomputation."""
    from carledger.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, *by: str) -> DataFrame:
    """The same as parquet files (partitioned by columns, if given), from
    which a reader takes the columns it needs. They go when the application
    ends, or when they are released."""
    from carledger.session import forget_at_exit, shared_path
    spark = df.sparkSession
    path = shared_path(spark, "staged")
    forget_at_exit(spark, path)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again; other
    tables are left."""
    from carledger.session import delete_path
    for t in tables:
        path = getattr(t, "_staged", None)
        if path:
            delete_path(t.sparkSession, path)
            t._staged = None


def drop_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished plans go: Spark deletes them when
    the driver's collector finds the plans unreachable."""
    gc.collect()
    spark._jvm.java.lang.System.gc()
