"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carledger.session import delete_path, shared_path, ship_package

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: one
    computation feeds several readers, and a lost executor costs a re-read.
    The files go when the application ends, or when they are released."""
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    for own in _COLLECTORS:
        own.append(out)
    return out


#: Lists that get the tables staged while they are here (``staged_in``).
_COLLECTORS: list[list] = []


@contextmanager
def staged_in(own: list):
    """``own`` gets every table that is staged within the block."""
    _COLLECTORS.append(own)
    try:
        yield own
    finally:
        _COLLECTORS.remove(own)


def release(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing will read again: what
    was computed from them is written itself. Other tables are left. The
    driver's collector is asked to run, as Spark deletes the shuffle files
    of a finished plan only when it finds the plan unreachable."""
    spark = None
    for t in tables:
        path = getattr(t, "_staged", None)
        if path:
            spark = t.sparkSession
            delete_path(spark, path)
            t._staged = None
    if spark is not None:
        gc.collect()
        spark._jvm.java.lang.System.gc()


def forget_at_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


#: Rows that a task and its Python worker exchange at once: whole texts are
#: a few kilobytes each, and both sides hold a batch in more than one form.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Python workers import this package by name, and get batches of at
    most ARROW_ROWS rows (a smaller setting of the session holds)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


#: Clears what an operator keeps in a Python worker between its tasks.
WORKER_CACHES: dict[str, Callable[[], None]] = {}


def only_caches_of(operator: str) -> None:
    """Called as a task begins: a worker serves many operators, and what the
    others remember in it would only take memory."""
    for name, clear in WORKER_CACHES.items():
        if name != operator:
            clear()


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def sized_parts(df: DataFrame) -> int:
    """Number of partitions for keyed shuffles: the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Most values that a label may have: a model keeps something for each.
MAX_LABELS = 256


def least_rows(df: DataFrame, by: str, key: Column, per: int, most: int | None = MAX_LABELS) -> DataFrame:
    """At most ``per`` rows of each value of the label ``by``, those with
    the least pseudo-random ``key``, a signed 64-bit hash. Rows with equal
    (by, key) count once. A first scan counts distinct hashes, a filter on
    the hash then leaves about ``4 * per`` rows of a value, so the final
    ranking sorts a bounded number of rows however many a value has. More
    than ``most`` labels are an error (None: any number, a row for each on
    the driver)."""
    keyed = df.withColumn("_key", key).filter(F.col(by).isNotNull())
    counts = keyed.groupBy(by).agg(F.approx_count_distinct("_key").alias("_n"))
    counts = (counts if most is None else counts.limit(most + 1)).collect()
    if most is not None and len(counts) > most:
        raise ValueError(f"{by} has more than {most} values")
    schema = f"`{by}` {df.schema[by].dataType.simpleString()}, _bound double"
    bounds = df.sparkSession.createDataFrame(
        [(r[by], -2.0 ** 63 + 2.0 ** 64 * min(1.0, 4.0 * per / max(1, r["_n"]))) for r in counts], schema)
    near = keyed.join(F.broadcast(bounds), by).filter(F.col("_key").cast("double") <= F.col("_bound"))
    once = near.drop("_bound").dropDuplicates([by, "_key"])
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_key"))
    return once.withColumn("_rank", rank).filter(F.col("_rank") <= per).drop("_rank", "_key")


def connected(edges: DataFrame, nodes: str = "a", others: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long node keys:
    (node, root) for every node that has an edge, ``root`` one node of its
    component. Each round every node moves to its least neighbour by a
    pseudo-random order (in which long chains halve at each round), edges
    are rewritten to the new names and repeated ones dropped, until none is
    left; names are then looked up once per round. Nothing is collected:
    rounds end when no edge is left. A hub with many neighbours is reduced
    by map-side minima, and its join is one that Spark splits.

    Every round's tables are written and read back; a plain checkpoint
    would carry the constraints of all earlier rounds into the next plan."""
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    u, v = F.least(nodes, others).alias("u"), F.greatest(nodes, others).alias("v")
    e = stage(edges.select(u, v).filter("u <> v").distinct(), "edges")
    names, old, salt = None, [], 0      # old: tables that ``names`` is read from
    while not e.isEmpty():
        salt += 1
        rank = F.struct(F.xxhash64(F.lit(salt), "v").alias("h"), F.col("v").alias("n"))
        own = F.struct(F.xxhash64(F.lit(salt), "u").alias("h"), F.col("u").alias("n"))
        least = stage(both(e).groupBy("u").agg(F.min(rank).alias("least"))
                      .select("u", F.least("least", own)["n"].alias("to")), "moves")
        if names is None:
            names, old = least.select(F.col("u").alias("node"), F.col("to").alias("root")), [least]
            gone = []
        else:
            step = least.withColumnRenamed("u", "root")
            gone = [least, *old]
            names = stage(names.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "names")
            old = [names]
        left, right = least.toDF("u", "nu"), least.toDF("v", "nv")
        rest = stage(e.join(left, "u").join(right, "v").filter("nu <> nv")
                     .select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct(), "edges")
        release(e, *gone)
        e = rest
    if names is None:
        names = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return names


#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it
    has at most BROADCAST_ROWS rows; a larger one is joined as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, by: list[Column], value: str) -> DataFrame:
    """A written table: ``df`` with its row number ``_i`` in the order of
    ``by``, from 0, and ``_before``, the sum of ``value`` over all earlier
    rows. Only the sums of the sorted partitions meet in one task."""
    def written(t: DataFrame) -> DataFrame:
        return stage(t, "numbered")
    rows = written(df.repartitionByRange(sized_parts(df), *by).sortWithinPartitions(*by)
                   .withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2 ** 33 - 1))
    rows = rows.withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("k"), F.sum(value).alias("v"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("_k"),
                         F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("_v"))
    own = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return written(rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(starts), "_part")
                   .withColumn("_i", (F.col("_k") + row).cast("long")).withColumn("_before", (F.col("_v") + F.col("_own")).cast("long"))
                   .drop("_id", "_part", "_own", "_k", "_v"))


def by_name(source: str = "source") -> list[Column]:
    """The order of sources: code points, null last."""
    return [F.col(source).isNull(), F.col(source)]


def batches(it: Iterator, rows: int) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows."""
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
