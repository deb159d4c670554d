"""Mixing sources to target weights along a training run.

Every source has a weight that varies over training time t in [0, 1],
given as knots (t, weight) joined by straight lines. A source's target is
a number of words: the total shared by weight (the integral of its
schedule), at most ``max_epochs`` times what it holds, the excess shared
again by weight among the rest.

A source's documents form one queue in pseudo-random order, read again from
the start for every further epoch. A copy belongs to the mix if the middle
of its words lies before the target. Its training position is the time at
which the source's cumulative demand, the integral of its schedule scaled to
the target, reaches that middle: the integral is inverted in closed form on
the knots' segments. Documents are then range-sorted by position.

Queue positions are sums over all earlier words of a source. They are split
in two levels, so that no source is sorted in one task: a source's queue is
cut by hash into about sqrt(n) buckets; sums of buckets are added up first,
then rows within each bucket. Both levels grow with the square root of the
data. Everything here is Spark's own functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carledger.llm.common import WORD, bounded, by_name, numbered, stage

#: Knots of a constant weight of one.
CONSTANT = ((0.0, 1.0), (1.0, 1.0))


def schedule_area(knots) -> float:
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))


def checked(knots) -> tuple[tuple[float, float], ...]:
    knots = tuple((float(t), float(w)) for t, w in knots)
    if (len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots)
            or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or schedule_area(knots) <= 0):
        raise ValueError(f"not a schedule over [0, 1]: {knots}")
    return knots


def targets(sizes: dict, schedules: dict, total: float, max_epochs: float) -> dict:
    """Words of each source: ``total`` shared by the integral of its
    schedule; what exceeds ``max_epochs`` of a source goes to the others by
    weight, until none is above. If all are full, that is the total."""
    weight = {s: schedule_area(schedules[s]) for s in sizes}
    out = {s: 0.0 for s in sizes}
    free, rest = {s for s in sizes if sizes[s] > 0}, float(total)
    while free and rest > 0:
        unit = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > max_epochs * sizes[s]}
        for s in full or free:
            out[s] = float(max_epochs * sizes[s]) if full else weight[s] * unit
        rest = rest - sum(out[s] for s in full) if full else 0.0
        free -= full or free
    return out


def position(demand: Column, knots) -> Column:
    """The time t at which the integral of the schedule is ``demand`` of its
    whole (0 to 1): within a segment from (t0, a) to (t1, b) the integral is
    a x + (b - a) x^2 / (2 (t1 - t0)), solved for x."""
    whole, done = schedule_area(knots), 0.0
    out = None
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        area = (t1 - t0) * (a + b) / 2
        need = F.least(F.greatest(demand * whole - done, F.lit(0.0)), F.lit(area))
        slope = (b - a) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * need, F.lit(0.0)))
        x = F.when(root + a > 0, 2 * need / (root + F.lit(a))).otherwise(F.lit(0.0))
        here = F.lit(t0) + F.least(x, F.lit(t1 - t0))
        out = here if out is None else F.when(demand * whole > done, here).otherwise(out)
        done += area
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Schedules:
    """Knots of each kind of schedule, and a table (source, kind) of the
    sources that have one, however many they are."""
    knots: list
    table: DataFrame


def schedules_of(sources: DataFrame, schedules=None, weights=None) -> Schedules:
    """``schedules`` and ``weights`` as in ``allocate``; ``sources``: a table
    of all sources. A function with ``cycle`` repeats it over the sources in
    Spark; any other gets the names, which then come to the driver."""
    if isinstance(schedules, Schedules):
        return schedules
    if callable(schedules) and hasattr(schedules, "cycle") and not weights:
        rows = numbered(sources.select("source").distinct().withColumn("_one", F.lit(1)), by_name(), "_one")
        kinds = [checked(k) for k in schedules.cycle]
        return Schedules(kinds, rows.select("source", (F.col("_i") % len(kinds)).cast("int").alias("kind")))
    if callable(schedules):
        names = [r["source"] for r in sources.select("source").distinct().collect()]
        schedules = schedules(sorted(names, key=lambda s: (s is None, s or "")))
    plans = {s: checked(k) for s, k in (schedules or {}).items()}
    plans |= {s: ((0.0, float(w)), (1.0, float(w))) for s, w in (weights or {}).items() if w > 0}
    kinds = list(dict.fromkeys(plans.values()))
    number = {k: i for i, k in enumerate(kinds)}
    return Schedules(kinds, sources.sparkSession.createDataFrame([(s, number[k]) for s, k in plans.items()], "source string, kind int"))


def by_kind(values: list, default) -> Column:
    """A constant of each kind of schedule."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind") + 1), F.lit(default))


def with_targets(sources: DataFrame, plans: Schedules, total_share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, size) with kind, weight and target, as
    ``targets`` has them: a source is full if its share exceeds what it
    holds; rounds raise the share of a unit of weight by what full sources
    leave, until none becomes full. Each is one aggregate."""
    t = sources.join(bounded(plans.table.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    t = stage(t.withColumn("weight", by_kind([schedule_area(k) for k in plans.knots], 0.0)), "weights")
    total = total_share * float(t.agg(F.sum("size")).first()[0] or 0)
    free = (F.col("size") > 0) & (F.col("weight") > 0)
    most = (F.lit(max_epochs) * F.col("size")).cast("double")
    unit, known = 0.0, -1
    while True:
        full = free & (F.col("weight") * F.lit(unit) > most)
        r = t.agg(F.count_if(full).alias("n"), F.sum(F.when(full, most)).alias("taken"),
                  F.sum(F.when(free & ~full, F.col("weight"))).alias("weight")).first()
        if r["n"] == known or not r["weight"] or total <= 0:
            break
        known, unit = r["n"], (total - (r["taken"] or 0.0)) / r["weight"]
    return t.withColumn("target", F.when(~free | F.lit(total <= 0), 0.0).otherwise(F.least(F.col("weight") * F.lit(unit), most)))


def allocate(docs: DataFrame, schedules=None, weights=None, total_share: float = 1.0, max_epochs: int = 3,
             size: Column | None = None, order: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``, which is kept whole in the struct
    column ``row``, with size, source_size, target, positions (one training
    time for each copy that the mix takes, ascending) and taken (words).

    ``schedules`` maps a source (None for null) to knots, or is a function
    from the sources in order of code points, null last, to such a map, or
    is Schedules; ``weights`` is the short form for constant ones. Missing sources weigh
    nothing. ``total_share``: the mix's size as a share of all words. ``size``
    and ``order`` (words of a row, and the 64-bit hash that orders a queue)
    are computed from the text unless given, for rows that come without it.

    Null texts and texts without words have size 0: they are taken once,
    for no words, at the place of their hash. Rows of a source are ordered
    by the hash of id and text, then id, so reruns agree; repeated rows
    follow each other and swap freely. An empty table gives an empty one; a
    very long text is one row of its size. Sizes, targets and kinds of schedules
    of the sources are a table that is joined."""
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"),
                       (word_count(F.col("text")) if size is None else size).cast("long").alias("size"),
                       (F.xxhash64("doc_id", "text") if order is None else order).alias("h"),
                       F.col("doc_id").alias("id"))
    held = stage(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "sources")
    plans = schedules_of(held, schedules, weights)
    sources = stage(with_targets(held, plans, total_share, max_epochs), "targets")
    buckets = max(1, int((held.agg(F.sum("n")).first()[0] or 0) ** 0.5))
    bucket = F.floor((F.shiftrightunsigned("h", 11).cast("double") * F.lit(2.0 ** -53)) * buckets).cast("long")

    per_bucket = (rows.select("source", "size", bucket.alias("bucket")).groupBy("source", "bucket")
                  .agg(F.sum("size").alias("words")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Broadcast if small, so that the rows with their texts are not shuffled for it.
    starts = bounded(stage(per_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                                             F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")), "starts"))
    before = (Window.partitionBy("source", "bucket").orderBy("order", "h", "id")
              .rowsBetween(Window.unboundedPreceding, -1))
    # Order by the same unsigned hash that cuts the buckets.
    queue = (rows.withColumn("bucket", bucket).withColumn("order", F.shiftrightunsigned("h", 1))
             .withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))))
    placed = (queue.join(starts, queue["source"].eqNullSafe(starts["s"]) & (queue["bucket"] == starts["b"]), "left")
              .select("row", "source", "size", (F.col("start") + F.col("within")).alias("at")))

    own = bounded(sources.select(F.col("source").alias("_s"), F.col("size").cast("long").alias("source_size"), "target", "kind"))
    placed = placed.join(own, placed["source"].eqNullSafe(own["_s"])).drop("_s")
    middle = lambda epoch: F.col("at") + epoch * F.col("source_size") + F.col("size") / 2
    in_mix = lambda epoch: F.when(
        F.col("source_size") == 0, epoch == 0).otherwise(
        (F.col("target") > 0) & ((middle(epoch) < F.col("target")) & ((F.col("size") > 0) | (epoch == 0))))
    demand = lambda epoch: F.when(F.col("target") > 0, F.least(
        middle(epoch) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    def times(epoch: Column) -> Column:
        out = F.lit(0.0)
        for i, k in enumerate(plans.knots):
            out = F.when(F.col("kind") == i, position(demand(epoch), k)).otherwise(out)
        return out
    epochs = F.filter(F.array(*[F.lit(i) for i in range(max_epochs)]), in_mix)
    return (placed.withColumn("positions", F.transform(epochs, times))
            .withColumn("taken", F.size("positions") * F.col("size"))
            .select("row", "size", "source_size", "target", "positions", F.col("taken").cast("long")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted
    by training position, its columns unchanged."""
    placed = allocate(docs, **how).select(F.explode("positions").alias("position"), "row")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ties and sources that share a position spread over the ranges by hash.
    key = ["position", F.xxhash64("row")]
    return placed.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("row.*")


#: Weights of the query's sources in order, repeating, and how strongly
#: each one's share falls or rises from the start of training to its end.
CYCLE = ((5.0, 1.5, 0.5), (2.0, 1.0, 1.0), (1.0, 0.5, 1.5))


def curriculum(names: list) -> dict:
    """Weights 5, 2, 1 over the sources; the heavy ones come earlier, the
    light ones later, their integrals staying 5, 2 and 1."""
    out = {}
    for i, s in enumerate(names):
        w, start, end = CYCLE[i % len(CYCLE)]
        out[s] = ((0.0, w * start), (1.0, w * end))
    return out


#: The same for any number of sources, repeated over them in Spark.
curriculum.cycle = list(curriculum(range(len(CYCLE))).values())


def allocation(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, words taken, and
    the first training position (null if not taken), sorted by it."""
    # Texts are read once, for their words; ids and numbers go on.
    narrow = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               F.xxhash64("doc_id", "text").alias("h")), "sizes")
    placed = allocate(narrow, schedules=curriculum, size=F.col("size"), order=F.col("h"))
    out = placed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
                        F.try_element_at("positions", F.lit(1)).alias("first_position"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "first_position", F.xxhash64("doc_id")).sortWithinPartitions("first_position")
