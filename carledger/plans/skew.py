"""Hot keys of per-key ordered scans (lag, last non-NULL, running sums).

A window ``partitionBy(key).orderBy(seq)`` sorts all rows of one key in one
task. For keys that hold a large share of the rows, the scan is split:

1. ``hot_keys``: if a group of keys (of a fixed number of groups) has more
   than ``carledger.hotKeyRows`` rows, one aggregate counts rows per key; a second, over the rows
   of keys with more than ``carledger.hotKeyRows`` rows (default 1,000,000),
   takes quantiles of their seq. The result is a written table, a row per
   hot key, however many there are; only a count and the largest number of
   rows come to the driver.
2. Rows of those keys get a ``piece`` number: the quantile range their seq
   lies in, so pieces hold about ``hotKeyRows`` rows each whatever the gaps
   between seqs, and every piece is an ordinary-sized window partition
   ``(key, piece)`` scanned in parallel.
3. Per piece, a one-row summary (last non-NULL values, sums) is
   carried to the next pieces with a small window over the summaries
   (pieces per key are few), joined back on ``(key, piece)``.

Ordinary keys keep the plain window; results are unioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carledger.plans.joins import materialize

PIECE = "_piece"


def _conf_int(df: DataFrame, name: str, default: int) -> int:
    v = df.sparkSession.conf.get(name, None)
    return int(v) if v else default


#: Groups of keys whose rows are counted before those of single keys.
GROUPS = 4096


def key_group(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS))


def hot_keys(df: DataFrame, key: str, seq: str) -> DataFrame | None:
    """Written table (key, _cuts) of the hot keys, or None: ``_cuts`` are
    ascending seq values between pieces."""
    rows = _conf_int(df, "carledger.hotKeyRows", 1_000_000)
    # A group of keys holds no less than each of its keys.
    groups = df.groupBy(key_group(key).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    if (groups.agg(F.max("_n")).first()[0] or 0) <= rows:
        return None
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    top = many.agg(F.max("_n")).first()[0]
    if top is None:
        return None
    many = materialize(many)
    pieces = -(-top // rows)
    shares = [i / pieces for i in range(1, pieces)]
    # A hot key's rows are many, so the quantiles are pre-aggregated.
    hot = df.select(key, seq).join(many.select(key), key)
    return materialize(hot.groupBy(key).agg(F.array_sort(F.array_distinct(
        F.percentile_approx(seq, shares, 20 * pieces))).alias("_cuts")))


def split(df: DataFrame, key: str, seq: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys with a ``_piece`` column).
    ``hot`` is joined as its size allows (Spark measures the written table)."""
    cold = df.join(hot.select(key), key, "left_anti")
    piece = F.size(F.filter("_cuts", lambda c: c < F.col(seq)))
    warm = df.join(hot, key).withColumn(PIECE, piece.cast("long")).drop("_cuts")
    return cold, warm


def carry_last_given(rows: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """Per (key, piece): for each column, the last non-NULL value in all
    earlier pieces (``_carry.<col>``)."""
    last = rows.groupBy(key, PIECE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])
    w = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return last.select(key, PIECE, F.struct(*[F.last(c, True).over(w).alias(c) for c in cols])
                       .alias("_carry"))


def carry_sum(rows: DataFrame, key: str, col: str) -> DataFrame:
    """Per (key, piece): the sum of ``col`` over all earlier pieces (0 if none)."""
    s = rows.groupBy(key, PIECE).agg(F.sum(col).alias("_s"))
    w = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return s.select(key, PIECE, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_carry_sum"))



def last_given_before(df: DataFrame, key: str, seq: str, col: str, default: str, out: str,
                      hot: DataFrame | None = None) -> DataFrame:
    """``out`` = the last non-NULL ``col`` among earlier rows (smaller
    ``seq``) of the same key, else the row's ``default`` column. Hot keys
    are cut into pieces; each piece starts from the earlier pieces' value."""
    def plain(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn(out, F.coalesce(F.last(col, True).over(w), F.col(default)))
    if hot is None:
        return plain(df)
    cold, warm = split(df, key, seq, hot)
    wp = Window.partitionBy(key, PIECE).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    j = warm.join(carry_last_given(warm, key, seq, [col]), [key, PIECE], "left")
    j = j.withColumn(out, F.coalesce(F.last(col, True).over(wp), F.col(f"_carry.{col}"), F.col(default)))
    return plain(cold).unionByName(j.drop("_carry", PIECE))


def sum_before(df: DataFrame, key: str, order: list[str], val: str, out: str,
               hot: DataFrame | None = None) -> DataFrame:
    """``out`` = sum of ``val`` over earlier rows of the same key in
    ``order`` (the first column is the seq that hot keys are cut by)."""
    def plain(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn(out, F.coalesce(F.sum(val).over(w), F.lit(0)))
    if hot is None:
        return plain(df)
    cold, warm = split(df, key, order[0], hot)
    wp = Window.partitionBy(key, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = warm.join(carry_sum(warm, key, val), [key, PIECE], "left")
    j = j.withColumn(out, F.col("_carry_sum") + F.coalesce(F.sum(val).over(wp), F.lit(0)))
    return plain(cold).unionByName(j.drop("_carry_sum", PIECE))


def carry_sums(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per (key, piece): sums of ``cols`` over all earlier pieces (``_carry``)."""
    s = rows.groupBy(key, PIECE).agg(*[F.sum(c).alias(c) for c in cols])
    w = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return s.select(key, PIECE, F.struct(*[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in cols])
                    .alias("_carry"))


def scan_before(df: DataFrame, key: str, seq: str, last: dict[str, tuple[str, str]],
                sums: dict[str, str], hot: DataFrame | None = None) -> DataFrame:
    """One ordered scan per key over earlier rows (smaller ``seq``):
    ``last[out] = (col, default)``: last non-NULL ``col`` else ``default``;
    ``sums[out] = col``: sum of ``col`` (0 if none). Hot keys are cut into
    pieces that start from the earlier pieces' values."""
    def plain(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return d.select("*", *[F.coalesce(F.last(c, True).over(w), F.col(dflt)).alias(o)
                               for o, (c, dflt) in last.items()],
                        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(o) for o, c in sums.items()])
    if hot is None:
        return plain(df)
    cold, warm = split(df, key, seq, hot)
    k = [key, PIECE]
    wp = Window.partitionBy(*k).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    lc = [c for c, _ in last.values()]
    sc = list(sums.values())
    j = warm
    if lc:
        j = j.join(carry_last_given(warm, key, seq, lc).withColumnRenamed("_carry", "_cl"), k, "left")
    if sc:
        j = j.join(carry_sums(warm, key, sc).withColumnRenamed("_carry", "_cs"), k, "left")
    j = j.select("*", *[F.coalesce(F.last(c, True).over(wp), F.col(f"_cl.{c}"), F.col(dflt)).alias(o)
                        for o, (c, dflt) in last.items()],
                 *[(F.coalesce(F.col(f"_cs.{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(wp), F.lit(0))).alias(o)
                   for o, c in sums.items()])
    return plain(cold).unionByName(j.drop(*[c for c in ("_cl", "_cs") if c in j.columns], PIECE))
