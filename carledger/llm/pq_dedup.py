"""Near-duplicate vectors by product quantisation.

Unit vectors are assigned to the nearest of LISTS centroids and their
residuals coded in SUBSPACES bytes, with the length of what the code misses.
A query probes every list that can hold a vector within the link radius: by
the distance to the plane between the list's centroid and its own. Inside a
list, distances to coded vectors are sums of table entries; a vector is a
candidate if that distance does not exceed the radius plus what its code
misses. Both bounds follow from the triangle inequality, so no link is lost,
and every candidate's cosine is then computed in double precision.

Only vectors of one label meet. A label's lists are laid out in blocks of at
most about BLOCK rows, a large list over several of them; a query goes once
to each block that holds a list it probes, and the queries of a block are
cut in chunks, so a task holds one block and one chunk. Equal vectors are one
class with a count. Tasks return link counts and, instead of pairs, edges to
one vector of each group of linked ones, at most one for each vector.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carledger.llm.common import bounded, connected, least_rows, ship, stage

THRESHOLD = 0.93
#: Vectors of a dimension that centroids and codes are learned from.
SAMPLE_ROWS = 8192
SUBSPACES, CODES, ROUNDS = 8, 256, 8
MOST_LISTS = 1024
BLOCK, CHUNK = 8192, 8192
#: Queries whose distances to a list are held at once, and pairs that are
#: verified at once; more than FOREST edges are reduced to a forest.
QUERIES, PAIRS, FOREST = 512, 65536, 500_000
#: Slack for single precision in distances.
SLACK = 2e-3


@dataclass(frozen=True)
class Codebook:
    lists: np.ndarray  # (lists, dimension)
    parts: tuple[slice, ...]
    codes: tuple[np.ndarray, ...]  # of each part: (codes, width)


def kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((c ** 2).sum(1)[None] - 2 * x @ c.T, axis=1)
        many = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[many > 0] = sums[many > 0] / many[many > 0, None]
    return c


def fit(x: np.ndarray, lists: int) -> Codebook:
    """Centroids and codes of the rows of x, unit vectors."""
    rng = np.random.default_rng(11)
    c = kmeans(x, lists, rng)
    rest = x - c[np.argmin((c ** 2).sum(1)[None] - 2 * x @ c.T, axis=1)]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    parts = tuple(slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:]))
    return Codebook(c, parts, tuple(kmeans(np.ascontiguousarray(rest[:, p]), CODES, rng) for p in parts))


def encode(book: Codebook, x: np.ndarray):
    """(list, codes, what the code misses, probed lists) of unit vectors."""
    c = book.lists
    d = (x ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None] - 2 * x @ c.T
    own = np.argmin(d, axis=1)
    rest = x - c[own]
    codes = np.empty((len(x), len(book.parts)), np.uint8)
    for m, (p, b) in enumerate(zip(book.parts, book.codes)):
        codes[:, m] = np.argmin((b ** 2).sum(1)[None] - 2 * rest[:, p] @ b.T, axis=1)
        rest[:, p] -= b[codes[:, m]]
    radius = math.sqrt(2 - 2 * THRESHOLD)
    apart = np.sqrt(np.maximum(0, ((c ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None] - 2 * c @ c.T)))
    beyond = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart[own], 1e-12)
    probed = (beyond <= radius + SLACK) | (np.arange(len(c))[None] == own[:, None])
    return own, codes, np.sqrt((rest ** 2).sum(1)), [np.flatnonzero(r).tolist() for r in probed]


def slices(book: Codebook, q: np.ndarray, probes: list, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, missed: np.ndarray):
    """(query, row) index pairs with cosine of at least THRESHOLD, those of
    QUERIES queries and one list at a time; vectors are given as they are,
    distances use their unit form."""
    unit = lambda v: (v / np.sqrt((v ** 2).sum(1))[:, None])
    uq = unit(q)
    radius = math.sqrt(2 - 2 * THRESHOLD)
    # |q - c - code|^2 = |q - c|^2 + (|code|^2 + 2 c code) - 2 q code
    fixed = np.zeros(len(x), np.float32)
    for m, (p, b) in enumerate(zip(book.parts, book.codes)):
        e = b[codes[:, m]]
        fixed += ((e ** 2).sum(1) + 2 * (book.lists[lists][:, p] * e).sum(1)).astype(np.float32)
    wanted: dict[int, list[int]] = {}
    for i, ls in enumerate(probes):
        for k in ls:
            wanted.setdefault(k, []).append(i)
    order = np.argsort(lists, kind="stable")
    tables = [(uq[:, p] @ b.T).astype(np.float32) for p, b in zip(book.parts, book.codes)]
    lengths, widths = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
        k = int(lists[rows[0]])
        limit = ((radius + missed[rows] + SLACK) ** 2).astype(np.float32)
        asked = np.array(wanted.get(k, []), np.int64)
        for i in range(0, len(asked), QUERIES):
            part = asked[i:i + QUERIES]
            near = ((uq[part] - book.lists[k]) ** 2).sum(1).astype(np.float32)
            d = near[:, None] + fixed[rows][None]
            for m, t in enumerate(tables):
                d -= 2 * t[part][:, codes[rows, m]]
            a, b = np.nonzero(d <= limit[None])
            for j in range(0, len(a), PAIRS):
                qi, xi = part[a[j:j + PAIRS]], rows[b[j:j + PAIRS]]
                keep = (q[qi] * x[xi]).sum(1) / (lengths[qi] * widths[xi]) >= THRESHOLD
                yield qi[keep], xi[keep]


def matches(*block) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``slices`` at once."""
    some = list(slices(*block))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[a for a, _ in some]]), np.concatenate([none, *[b for _, b in some]])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) of the graph of pairs."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(names))
    return names[far], names[label[far]]


CLASS = "node long, label string, dim int, many long, vector array<float>"
CODED = CLASS + ", list int, codes binary, missed double, probes array<int>"
FOUND = "node long, links long, other long"


def _valid():
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.col("label").isNotNull() & e.isNotNull() & F.coalesce(F.forall(e, finite), F.lit(False))
            & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False)))


def links(vectors: DataFrame) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label; others
    are ignored): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    and those with a null label link with nothing. Vectors of one label but
    different length never link. Equal vectors are linked (also those of
    equal vec_id, each row counting); a null vec_id names a component only if
    it has no other. An empty table gives an empty one."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding").cast("array<float>")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), e.alias("embedding"), _valid().alias("ok"))
    rows = rows.select("*", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    classes = stage(rows.filter("ok").groupBy("label", "k1", "k2").agg(
        F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least"), F.first("embedding").alias("vector"))
        .select("*", F.monotonically_increasing_id().alias("node"), F.size("vector").alias("dim")), "vector-classes")
    books = train(classes)
    coded = stage(_coded(classes, books), "vector-codes")
    found = stage(_search(coded, books), "vector-links")
    count = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    edges = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    names = connected(edges)
    full = (classes.select("label", "k1", "k2", "node", "least").join(count, "node", "left").join(names, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    lowest = full.groupBy("root").agg(F.min("least").alias("component_id"))
    full = stage(full.join(lowest, "root").select(F.col("label").alias("_l"), F.col("k1").alias("_k1"),
                                                  F.col("k2").alias("_k2"), "n_links", "component_id"), "vector-components")
    same = (rows["label"] == full["_l"]) & (rows["k1"] == full["_k1"]) & (rows["k2"] == full["_k2"]) & rows["ok"]
    out = rows.join(full, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def train(classes: DataFrame) -> dict[int, Codebook]:
    """A codebook for each length of vectors, from at most SAMPLE_ROWS
    classes of it. The number of lists grows with the square root of the
    classes of a label."""
    sizes = {r["dim"]: (r["n"], r["labels"]) for r in classes.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).collect()}
    sample = least_rows(classes.select("dim", "vector", "k1"), "dim", F.col("k1"), SAMPLE_ROWS, None).select("dim", "vector")
    by: dict[int, list] = {}
    for r in sample.collect():  # bounded by SAMPLE_ROWS of a length
        by.setdefault(r["dim"], []).append(r["vector"])
    out = {}
    for dim, v in by.items():
        x = np.array(sorted(v), np.float64)
        n, labels = sizes[dim]
        out[dim] = fit(x / np.sqrt((x ** 2).sum(1))[:, None],
                       int(min(MOST_LISTS, max(1, math.sqrt(n / max(1, labels)) / 4))))
    return out


def _coded(classes: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    def coded(it):
        for pdf in it:
            for dim, rows in pdf.groupby("dim"):
                x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
                own, codes, missed, probes = encode(books[dim], x / np.sqrt((x ** 2).sum(1))[:, None])
                yield rows.assign(list=own, codes=[c.tobytes() for c in codes], missed=missed, probes=probes)
    return classes.select("node", "label", "dim", "many", "vector").mapInPandas(coded, CODED)


def _search(coded: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """(node, links, null) link counts by block and (node, null, other)
    edges to one node of each linked group."""
    from pyspark.sql import Window
    key = ["label", "dim"]
    lists = coded.groupBy(*key, "list").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy(*key).orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    # Lists follow each other in blocks; a large one has blocks of its own.
    lists = (lists.withColumn("split", F.ceil(F.col("k") / BLOCK).cast("int"))
             .withColumn("room", F.when(F.col("split") > 1, F.col("split") * BLOCK).otherwise(F.col("k")))
             .withColumn("start", F.floor(F.coalesce(F.sum("room").over(before), F.lit(0)) / BLOCK).cast("int")))
    plan = lists.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(
        "list", F.struct("start", "split")))).alias("plan"))
    plan = bounded(stage(plan, "plan"))
    at = coded.join(plan, key)
    # A split list begins in a block that a smaller one may share.
    own = F.col("plan")[F.col("list")]
    block = own["start"] + F.when(own["split"] > 1, F.pmod(F.xxhash64("node"), own["split"]).cast("int")).otherwise(0)
    visited = F.array_distinct(F.flatten(F.transform(F.filter("probes", lambda k: F.col("plan")[k].isNotNull()), lambda k: F.sequence(
        F.col("plan")[k]["start"], F.col("plan")[k]["start"] + F.col("plan")[k]["split"] - 1))))
    stored = at.select(*key, "node", "many", "vector", "list", "codes", "missed", block.alias("block"))
    asked = at.select(*key, "node", "vector", "probes", F.explode(visited).alias("block"))
    chunks = bounded(stage(asked.groupBy(*key, "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "chunks"))
    group = [*key, "block"]
    empty = lambda t: F.lit(None).cast(t)
    stored = stored.join(chunks, group).select(
        *group, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "many", "vector", "list", "codes",
        "missed", empty("array<int>").alias("probes"))
    asked = asked.join(chunks, group).select(
        *group, F.pmod(F.xxhash64(F.lit(3), "node"), F.col("chunks")).cast("int").alias("chunk"), "node",
        empty("long").alias("many"), "vector", empty("int").alias("list"), empty("binary").alias("codes"),
        empty("double").alias("missed"), "probes")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["probes"].notna().to_numpy()
        q, x = pdf[is_query], pdf[~is_query]
        none = pd.DataFrame({"node": [], "links": [], "other": []}, dtype="Int64")
        if not len(q) or not len(x):
            return none
        wide = lambda rows: np.stack(rows["vector"].to_numpy()).astype(np.float64)
        asks, has = q["node"].to_numpy(np.int64), x["node"].to_numpy(np.int64)
        many, sums = x["many"].to_numpy(np.int64), np.zeros(len(q), np.int64)
        edges, size = [(np.zeros(0, np.int64),) * 2], 0
        # Pairs of a slice are counted and joined to a forest, never kept.
        for qi, xi in slices(books[int(pdf["dim"].iloc[0])], wide(q), list(q["probes"]), wide(x),
                             x["list"].to_numpy(np.int64), np.stack([np.frombuffer(c, np.uint8) for c in x["codes"]]),
                             x["missed"].to_numpy(float)):
            a, b = asks[qi], has[xi]
            np.add.at(sums, qi, many[xi] - (a == b))
            edges.append((a, b))
            size += len(a)
            if size > FOREST:
                edges = [spanning(*map(np.concatenate, zip(*edges)))]
                size = 0
        some = sums > 0
        nodes, others = spanning(*map(np.concatenate, zip(*edges)))
        return pd.concat([pd.DataFrame({"node": q["node"].to_numpy()[some], "links": sums[some]}),
                          pd.DataFrame({"node": nodes, "other": others})]).reindex(
                              columns=["node", "links", "other"]).astype("Int64")
    return stored.unionByName(asked).groupBy(*group, "chunk").applyInPandas(linked, FOUND)
