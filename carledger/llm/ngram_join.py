"""Jaccard self-join on five-word shingles with adaptive prefixes.

A document is its set of distinct shingles. All sets are sorted by one global
order, rare shingles first, so two sets that are similar enough share a
shingle in short prefixes. A document whose prefix holds frequent shingles
lengthens it by l - 1 shingles and asks in return that more of them be
shared: of a pair that needs an intersection of o, at least o - n + p lie in
the prefix of length p of each side. l minimises the estimated cost of
reading postings and verifying candidates.

1. Frequencies: every shingle of every document adds to one of 2^22
   counters. They are summed over all tasks and give each counter a level,
   the logarithm of its excess over the mean. The table of levels has a
   fixed size; it only shapes the order, so shared counters cost time, not
   results.
2. Prefixes: tasks emit prefix shingles, packed. Those that one document
   alone has are dropped where they meet; frequent ones, which cannot be
   alone, skip that meeting, so no task gathers them.
3. Links: copies are one class. First each shingle pairs its documents with
   one of them only, pairs are verified on whole sets, and linked classes
   become components. What remains are pairs of different components; all of
   those that share enough prefix shingles are then verified. Pairs inside a
   component are never listed: they could not change it.

No component, link or fingerprint comes to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carledger.llm.common import WORKER_CACHES, batches, bounded, connected, only_caches_of, release, ship, sized_parts, stage

SHINGLE = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
COUNTER_BITS, SLICE_BITS = 22, 14
#: A level counts the doublings of a counter's excess, from 2^4 on, over
#: noise of six deviations. From HOT on a shingle is surely not alone.
NOISE, LEAST_EXCESS, HOT = 6.0, 16, 10
#: Largest number of shared shingles asked for, and the cost of verifying a
#: pair in postings read.
MOST_SHARED, VERIFY_COST = 8, 20.0
#: Packed shingles that meet in one part, and shingles a task holds at once.
PART_TOKENS, TASK_TOKENS = 1_000_000, 400_000
#: Classes of a component that are compared at once, and classes with them.
BLOCK = 512
#: Rounds of pairing with few documents only, as many at every size, and
#: members of a larger component that smaller ones are paired with in one.
ROUNDS, HUBS = 2, 64

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_TOKEN = np.uint64(2 ** 48 - 1)


class _Words(dict):
    """64-bit hashes of words, remembered by a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
WORKER_CACHES["ngram_join"] = _WORDS.clear


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z in lower
    case, words between ASCII white space; with fewer than five words the
    whole sequence is one; without words there is none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if not n:
        return w
    if n < SHINGLE:
        h = (w * _ODD[:n]).sum(keepdims=True) + np.full(1, n, np.uint64) * _ODD[5]
    else:
        h = w[:n - 4] * _ODD[0]
        for k in range(1, SHINGLE):
            h += w[k:n - 4 + k] * _ODD[k]
    h ^= h >> np.uint64(33)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def needed(n: int) -> int:
    """Least intersection of a set of n with any set that it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def shared_needed(n, m, d, e):
    """Least number of shared prefix shingles of a linked pair of sizes n and
    m, where d and e are prefix length less size: all but n - o shingles of a
    set are common, so p - (n - o) of its prefix are, and as common shingles
    stand in the same order in both, the smaller of the two counts is shared."""
    total = NUMERATOR + DENOMINATOR
    return F.ceil((n + m) * F.lit(NUMERATOR) / F.lit(total)) + F.least(d, e)


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def levels_of(counts: np.ndarray, total: int) -> np.ndarray:
    mean = total / len(counts)
    excess = counts - mean - NOISE * np.sqrt(mean)
    return np.where(excess >= LEAST_EXCESS, np.log2(np.maximum(excess, 1)).astype(np.int64), 0).astype(np.uint8)


def prefix(h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles of the prefix in order, their levels, l) of a set."""
    n = len(h)
    level = levels[counter_of(h)]
    order = np.argsort((level.astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6)), kind="stable")
    short = n - needed(n) + 1
    top = min(MOST_SHARED, needed(n))
    others = np.exp2(level[order[:short + top - 1]].astype(float)) - 1
    scan = np.cumsum(others)[short - 1:]
    shared = np.arange(1, top + 1)
    ell = int(np.argmin(short + shared - 1 + (1 + VERIFY_COST / shared) * scan)) + 1
    take = order[:short + ell - 1]
    return h[take], level[take], ell


def frequency_levels(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Levels of all counters and the number of shingles, over all rows of
    ``docs`` (text). Each task adds up its own counters and emits them in
    slices; slices are summed where they meet."""
    n, width = 1 << (COUNTER_BITS - SLICE_BITS), 1 << SLICE_BITS

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("ngram_join")
        counts = np.zeros(1 << COUNTER_BITS, np.int32)
        held, size = [], 0

        def add():
            np.add(counts, np.bincount(counter_of(np.concatenate(held)), minlength=len(counts)), out=counts,
                   casting="unsafe")
        for b in it:
            for t in b.column(0).to_pylist():
                held.append(shingles(t))
                size += len(held[-1])
                if size > TASK_TOKENS:
                    add()
                    held, size = [], 0
        if held:
            add()
        if counts.any():
            yield pa.record_batch([pa.array(range(n), pa.int32()), pa.array(
                [zlib.compress(x.tobytes(), 1) for x in counts.reshape(n, width)], pa.binary())], names=["slice", "counts"])

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                c = np.frombuffer(zlib.decompress(x.as_buffer()), np.int32)
                total[k] = total[k] + c if k in total else c.astype(np.int64)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(
            [zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "counts"])
    schema = "slice int, counts binary"
    slices = (docs.select("text").mapInArrow(counted, schema).repartition(min(n, sized_parts(docs)), "slice")
              .mapInArrow(summed, schema))
    counts = np.zeros((n, width), np.int64)
    for r in slices.collect():  # a fixed number of counters
        counts[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    total = int(counts.sum())
    return levels_of(counts.ravel(), total), total


PACKED = ("part int, kind int, token long, ref long, doc_id long, h long, sig binary, n int, ell int, "
          "tokens binary, seqs binary")
POSTINGS = "kind int, token long, ref long, doc_id long, h long, sig binary, n int, ell int"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(columns[k], _KINDS[t]) if k in columns else pa.nulls(rows, _KINDS[t])
                            for k, t in fields], names=[k for k, _ in fields])


def postings(docs: DataFrame, levels: np.ndarray, total: int) -> DataFrame:
    """A written table: kind 0, one row for each document (doc_id, h, ref,
    signature of its set, n, l); kind 1, prefix shingles (token, ref) that
    two documents or more may share. ``ref`` is a row's task and number."""
    spark = docs.sparkSession
    parts = max(sized_parts(docs), total * (DENOMINATOR - NUMERATOR) // DENOMINATOR // PART_TOKENS + 1)
    shared = spark.sparkContext.broadcast(levels)

    def emitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shared.value, TaskContext.get().partitionId() << 32
        seq, held, refs, size = 0, [], [], 0

        def flush():
            tokens = np.concatenate(held) & _TOKEN
            seqs = np.repeat(np.array(refs, np.uint32), [len(x) for x in held])
            part = (tokens % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            bytes6 = tokens[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            steps = np.diff(seqs[order].astype(np.int64), prepend=0)
            some = [p for p in range(parts) if edge[p] < edge[p + 1]]
            packed = []
            for p in some:
                d = steps[edge[p]:edge[p + 1]].copy()
                d[0] = seqs[order[edge[p]]]
                packed.append(zlib.compress(d.astype("<u4").tobytes(), 1))
            return _batch(PACKED, len(some), part=some, kind=[2] * len(some), ref=[base] * len(some),
                          tokens=[bytes6[edge[p]:edge[p + 1]].tobytes() for p in some], seqs=packed)
        for b in batches(it, 2000):
            rows, hot_tokens, hot_refs = [], [], []
            for doc_id, h, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = shingles(text)
                if len(s):
                    first, level, ell = prefix(s, table)
                    alone = first[level < HOT]
                    hot = first[level >= HOT] & _TOKEN
                    held.append(alone)
                    refs.append(seq)
                    size += len(alone)
                    hot_tokens += hot.tolist()
                    hot_refs += [base + seq] * len(hot)
                    rows.append((seq % parts, base + seq, doc_id, h, xxhash.xxh3_128_digest(s.tobytes()), len(s), ell))
                else:
                    rows.append((seq % parts, base + seq, doc_id, h, None, 0, 1))
                seq += 1
            c = list(zip(*rows)) or [()] * 7
            yield _batch(PACKED, len(rows), part=c[0], kind=[0] * len(rows), ref=c[1], doc_id=c[2], h=c[3], sig=c[4],
                         n=c[5], ell=c[6])
            if hot_tokens:
                yield _batch(PACKED, len(hot_tokens), part=[i % parts for i in range(len(hot_tokens))],
                             kind=[1] * len(hot_tokens), token=hot_tokens, ref=hot_refs)
            if size > TASK_TOKENS:
                yield flush()
                held, refs, size = [], [], 0
        if size:
            yield flush()

    def met(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in POSTINGS.split(", ")]
        part, tokens, refs = None, [], []

        def several():
            t, r = np.concatenate(tokens), np.concatenate(refs)
            order = np.argsort(t, kind="stable")
            t, r = t[order], r[order]
            same = t[1:] == t[:-1]
            keep = np.append(same, False) | np.append(False, same)
            return _batch(POSTINGS, int(keep.sum()), kind=np.ones(int(keep.sum()), np.int32),
                          token=t[keep].astype(np.int64), ref=r[keep])
        for b in it:
            packed = np.array(b.column("kind")) == 2
            if not packed.all():
                yield b.filter(pa.array(~packed)).select(names)
            for p, base, x, s in zip(*(b.filter(pa.array(packed)).column(k).to_pylist()
                                       for k in ("part", "ref", "tokens", "seqs"))):
                if p != part and tokens:
                    yield several()
                    tokens, refs = [], []
                part = p
                wide = np.zeros((len(x) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
                tokens.append(wide.view("<u8")[:, 0])
                refs.append(np.cumsum(np.frombuffer(zlib.decompress(s), "<u4").astype(np.int64)) + base)
        if tokens:
            yield several()
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("h"), "text")
    packed = rows.mapInArrow(emitted, PACKED).repartition(parts, "part").sortWithinPartitions("part")
    return stage(packed.mapInArrow(met, POSTINGS), "postings")


def _sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, items): whole sets of the wanted classes, whose documents
    (doc_id, h, node) are given. ``repeated``: rows may be equal in both."""
    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 500):
            yield pa.record_batch([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()],
                                                         pa.binary())], names=["node", "items"])
    w = bounded(wanted.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "node"))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("h"), "text")
    hit = rows.join(w, rows["doc_id"].eqNullSafe(w["_id"]) & (rows["h"] == w["_h"])).select("node", "text")
    if repeated:
        hit = hit.dropDuplicates(["node"])
    return stage(hit.mapInArrow(found, "node long, items binary"), "sets")


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        out.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The (a, b) pairs whose whole sets are similar, with their other
    columns, written. Sets are made from the texts of the classes that a
    pair names, and let go again."""
    written = stage(pairs, "pairs")
    pairs = bounded(written)
    nodes = stage(written.select(F.col("a").alias("node")).union(written.select("b")).distinct(), "nodes-of-pairs")
    sets = sets_of(nodes)
    # Only sets that a pair names go through the join's shuffle.
    own = stage(written.select("a").distinct(), "named")
    named = bounded(own)
    left = sets.select(F.col("node").alias("b"), F.col("items").alias("_b"))
    right = sets.join(named, sets["node"] == named["a"]).select("a", F.col("items").alias("_a"))
    # A class that many pairs name is on the side that Spark can split.
    both = left.join(pairs, "b").join(right, "a")
    links = stage(both.filter(F.pandas_udf(_similar, "boolean")("_a", "_b")).drop("_a", "_b"), "links")
    release(written, own, nodes, sets)
    return links


def _near(n: str, m: str):
    """Sizes allow a link."""
    return ((F.col(n) * NUMERATOR <= F.col(m) * DENOMINATOR) & (F.col(m) * NUMERATOR <= F.col(n) * DENOMINATOR))


def components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others are ignored):
    doc_id, h (hash of id and text), n_shingles, component_id, component
    (an internal key of the component, never null).

    Null and empty texts have an empty set, link with nothing and are their
    own component. Rows with equal sets are one class; a null doc_id is
    never a component's name unless it has no other. Very long texts have
    one set each, in one task; ties in the order of shingles fall by hash and
    change no result. Repeated rows are repeated in the result; an empty
    table gives an empty one."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    levels, total = frequency_levels(docs)
    found = postings(docs, levels, total)
    rows = stage(found.filter("kind = 0").select("doc_id", "h", "sig", "n", "ell", "ref"), "rows")
    one = F.struct("ref", "doc_id", "h", "n", "ell")
    classes = stage(rows.filter("sig is not null").groupBy("sig").agg(F.min(one).alias("one"), F.min("doc_id").alias("least"))
                    .select("sig", "least", F.col("one.ref").alias("node"), "one.doc_id", "one.h", "one.n", "one.ell"),
                    "classes")
    # Postings of one document of each class; ``short`` is prefix less size.
    short = F.col("ell") - F.ceil(F.col("n") * F.lit(NUMERATOR) / F.lit(DENOMINATOR))
    posted = (found.filter("kind = 1").select("token", F.col("ref").alias("node"))
              .join(classes.select("node", "n", short.cast("int").alias("short")), "node"))
    whole = stage(posted, "postings-of-classes")
    release(found)
    posted = _linkable(whole)
    release(whole)
    wanted = stage(posted.select("node").distinct().join(classes.select("node", "doc_id", "h"), "node"), "wanted")
    names = None
    if not wanted.isEmpty():
        repeated = not rows.groupBy("doc_id", "h").count().filter("count > 1").isEmpty()

        def sets_of(nodes: DataFrame) -> DataFrame:
            own = stage(wanted.join(nodes, "node"), "wanted-now")
            sets = _sets(docs, own, repeated)
            release(own)
            return sets
        names = _link(posted, sets_of)
    release(wanted)
    if names is not None:
        classes = classes.join(names, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lowest = stage(classes.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
        classes = stage(classes.join(lowest, "root").select("sig", "component_id", F.col("root").alias("component")),
                        "class-components")
    else:
        classes = classes.select("sig", F.col("least").alias("component_id"), F.col("node").alias("component"))
    out = rows.join(classes.withColumnRenamed("sig", "_sig"), F.col("sig") == F.col("_sig"), "left")
    return out.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce("component", "ref").alias("component"))


def _linkable(posted: DataFrame) -> DataFrame:
    """Postings of classes that can have a link, of shingles that two have:
    a class needs as many shared shingles as its most lenient partner would
    ask for."""
    token = posted.groupBy("token").agg(F.count("node").alias("k"), F.min("n").alias("lo"), F.min("short").alias("other"))
    several = stage(token.filter("k > 1").drop("k"), "tokens")
    p = stage(posted.join(several, "token"), "posted")
    least = F.ceil(F.col("n") * F.lit(NUMERATOR) / F.lit(DENOMINATOR))
    node = p.groupBy("node", "n", "short").agg(F.count("token").alias("k"), F.min("lo").alias("lo"), F.min("other").alias("other"))
    alive = node.filter(F.col("k") >= shared_needed(F.col("n"), F.greatest("lo", least), F.col("short"), F.col("other")))
    alive = stage(alive.select("node"), "alive")
    left = p.select("token", "node", "n", "short").join(alive, "node")
    again = stage(left.groupBy("token").agg(F.count("node").alias("k")).filter("k > 1").select("token"), "tokens")
    out = stage(left.join(again, "token"), "posted")
    release(several, p, alive, again)
    return out


def _link(posted: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of all classes of ``posted`` (token, node, n, short);
    ``sets_of`` gives the whole sets of some of them.

    First every shingle pairs its classes with one of them. Then, while the
    pairs of different components outnumber the postings, classes of smaller
    components are paired with HUBS members of larger ones, other members in
    every round. At last all pairs of different components are verified that
    share enough shingles; only those are left out that could not change a
    component."""
    nodes = stage(posted.select("node").distinct().withColumn("root", F.col("node")), "nodes")
    p, read = posted.withColumn("root", F.col("node")), [posted, nodes]     # read: tables of p and nodes

    def merge(pairs: DataFrame, *used: DataFrame) -> bool:
        """Verify pairs, join components; ``used``: tables of the pairs."""
        nonlocal nodes, p, read
        new = verified(pairs, sets_of)
        release(*used)
        if new.isEmpty():
            release(new)
            return False
        comps = connected(new, "root_a", "root_b")
        moves = comps.toDF("root", "to")
        moved = lambda t: t.join(moves, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        nodes = stage(moved(nodes), "nodes")
        p = moved(p)
        ends = p.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        several = stage(ends.select("token"), "tokens")
        p = stage(p.join(several, "token"), "posted")
        release(several, new, comps, *read)
        read = [p, nodes]
        return True

    def shared(found: DataFrame, share: float = 1.0) -> DataFrame:
        """Pairs (node, hub) that share as many shingles as both ask for, or
        a share of it where not all of their shingles are in ``found``."""
        return (found.filter((F.col("root") != F.col("hub_root")) & _near("n", "hub_n")).groupBy("node", "hub").agg(
            F.count("token").alias("k"), F.first(shared_needed(F.col("n"), F.col("hub_n"), F.col("short"), F.col("hub_short"))).alias("least"),
            F.first("root").alias("root_b"), F.first("hub_root").alias("root_a"))
            .filter(F.col("k") >= share * F.col("least")).select(F.col("hub").alias("a"), F.col("node").alias("b"), "root_a", "root_b"))

    def pairs_left() -> tuple[float, int]:
        within = p.groupBy("token", "root").agg(F.count("node").cast("double").alias("k"))
        each = within.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
        r = each.agg(F.sum((F.col("k") * F.col("k") - F.col("own")) / 2).alias("pairs"), F.sum("k").alias("rows")).first()
        return r["pairs"] or 0.0, r["rows"] or 0
    hub = lambda t: t.select("token", *[F.col(c).alias(f"hub_{c}") for c in ("n", "short", "root")],
                             F.col("node").alias("hub"))
    first = p.groupBy("token").agg(F.min(F.struct(F.xxhash64("node"), "node", "n", "short", "root")).alias("r"))
    hubs = stage(hub(first.select("token", "r.*")), "hubs")
    found = merge(shared(p.join(hubs, "token"), 0.1), hubs)
    for turn in range(1, ROUNDS):
        pairs, rows = pairs_left()
        if not found or pairs <= 4 * rows:
            break
        sizes = stage(nodes.groupBy("root").agg(F.count("node").alias("size")).filter("size > 1"), "sizes")
        rank = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64(F.lit(turn), "node")))
        few = p.select("node", "root").distinct().join(sizes, "root").withColumn("rank", rank).filter(F.col("rank") <= HUBS)
        few = stage(few.select("node", "size"), "few")
        hubs = stage(
            p.join(few, "node").select(
                "token", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("short").alias("hub_short"),
                F.col("root").alias("hub_root"), F.col("size").alias("hub_size")), "hubs")
        asked = p.join(sizes, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        smaller = F.struct("size", "root") < F.struct("hub_size", "hub_root")
        found = merge(shared(asked.join(hubs, "token").filter(smaller)), sizes, few, hubs)
    if not p.isEmpty():
        sizes = stage(nodes.groupBy("root").agg(F.count("node").alias("size")), "sizes")
        merge(*_all_pairs(p.join(sizes, "root")), sizes)
    release(*[t for t in read if t is not nodes])
    return nodes


PAIRS = "a long, b long, root_a long, root_b long"


def _all_pairs(p: DataFrame) -> list[DataFrame]:
    """All pairs of classes of different components that share as many
    shingles as both ask for, and the tables they are read from; ``p``:
    postings with root and its size.

    A class is matched with the larger components that it shares shingles
    with. If a pair shares t of the postings here, the first shared one, in
    any common order, has t - 1 more after it on both sides, so a class and
    a component meet only in shingles that leave both that room. The members of such a component are cut into blocks, the classes
    matched with it into chunks; a task counts shared shingles of one block
    and one chunk and returns only pairs that share enough."""
    after = F.count(F.lit(1)).over(Window.partitionBy("node")) - F.row_number().over(Window.partitionBy("node").orderBy("token"))
    p = stage(p.withColumn("after", after.cast("int")), "rooms")
    here = p.groupBy("token", "root", "size").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("short").alias("other"), F.max("after").alias("room")).toDF(
        "token", "into", "into_size", "lo", "hi", "other", "room")
    smaller = F.struct("size", "root") < F.struct("into_size", "into")
    fits = (F.col("lo") * NUMERATOR <= F.col("n") * DENOMINATOR) & (F.col("n") * NUMERATOR <= F.col("hi") * DENOMINATOR)
    least = shared_needed(F.col("n"), F.greatest("lo", F.ceil(F.col("n") * F.lit(NUMERATOR) / F.lit(DENOMINATOR))),
                          F.col("short"), F.col("other"))
    room = F.least("after", "room") >= least - 1
    here = stage(here, "roots")
    asked = stage(p.join(here, "token").filter(smaller & fits & room).select("node", "into").distinct(), "asked")
    release(here)
    members = stage(p.groupBy("node", "root", "n", "short").agg(F.collect_list("token").alias("tokens")), "members")
    many = members.groupBy(F.col("root").alias("into")).agg(F.ceil(F.count("node") / BLOCK).cast("int").alias("blocks"))
    plan = asked.groupBy("into").agg(F.ceil(F.count("node") / BLOCK).cast("int").alias("chunks")).join(many, "into")
    written = stage(plan, "plan")
    plan = bounded(written)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = ["node", "n", "short", "root", "tokens"]
    held = (members.join(plan, members["root"] == plan["into"])
            .select("into", pick("blocks").alias("block"), spread("chunks").alias("chunk"), F.lit(0).alias("side"), *own))
    asks = (asked.join(members, "node").join(plan, "into")
            .select("into", spread("blocks").alias("block"), pick("chunks").alias("chunk"), F.lit(1).alias("side"), *own))
    key = ["into", "block", "chunk"]
    rows = held.unionByName(asks).repartition(sized_parts(p), *key).sortWithinPartitions(*key, "side")
    return [rows.mapInArrow(_count_blocks, PAIRS), p, asked, members, written]


def _count_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, asks = None, [], []
    for b in batches(it, 500):
        for r in b.to_pylist():
            k = (r["into"], r["block"], r["chunk"])
            if k != key:
                yield from _count_block(held, asks)
                key, held, asks = k, [], []
            (asks if r["side"] else held).append(r)
    yield from _count_block(held, asks)


def _count_block(held: list[dict], asks: list[dict]) -> Iterator[pa.RecordBatch]:
    if not held or not asks:
        return
    column = lambda rows, c: np.array([r[c] for r in rows], np.int64)
    tokens = np.concatenate([np.array(r["tokens"], np.int64) for r in held])
    owner = np.repeat(np.arange(len(held)), [len(r["tokens"]) for r in held])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    node, n, short = (column(held, c) for c in ("node", "n", "short"))
    out = []
    for r in asks:
        t = np.array(r["tokens"], np.int64)
        a, b = np.searchsorted(tokens, t), np.searchsorted(tokens, t, "right")
        at = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        k = np.bincount(owner[at], minlength=len(held))
        total = NUMERATOR + DENOMINATOR
        least = -(-(n + r["n"]) * NUMERATOR // total) + np.minimum(short, r["short"])
        near = (n * NUMERATOR <= r["n"] * DENOMINATOR) & (r["n"] * NUMERATOR <= n * DENOMINATOR)
        out += [(int(y), r["node"], held[0]["root"], r["root"]) for y in node[near & (k >= least) & (k > 0)]]
    if out:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in PAIRS.split(", ")])


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the
    row with the smallest doc_id stays (of equal ids the one with the least
    hash of id and text); rows equal in id and text count once. Documents
    without words all stay. Components are told apart by an internal key, as
    those without any id have no name."""
    found = stage(components(docs), "components")
    own = F.struct(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("i"), "h", "doc_id")
    full = found.filter("n_shingles > 0")
    first = stage(full.groupBy("component").agg(F.min(own).alias("first")), "first")
    joined = full.join(first, "component")
    gone = joined.filter(F.col("h") != F.col("first.h")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64("doc_id", "text").alias("h"))
    gone = bounded(stage(gone, "gone"))
    kept = rows.join(gone, rows["id"].eqNullSafe(gone["_id"]) & (rows["h"] == gone["_h"]), "left_anti")
    if not full.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        wordless = kept.filter(~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
        kept = (kept.filter(F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
                .dropDuplicates(["id", "h"]).union(wordless))
    return kept.select("row.*")
