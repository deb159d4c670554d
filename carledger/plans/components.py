"""Connected components of an undirected graph of text or number nodes.

Each round, every partition joins its own edges to trees (in arrays) and
names a root for each of its nodes; a node that lies in several partitions
moves to the least of its roots, by a pseudo-random order that is another in
every round, and what is left are edges between roots. A graph that fits in
one partition needs one round, a chain over many partitions a logarithmic
number of them; once no more than ``LAST_EDGES`` edges are left, the next
round is the last. Of more, a hub's edges stay where they lie, so no task
gathers them. Nothing but the number of edges left comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carledger.plans.joins import materialize
from carledger.session import ship_package

#: Edges so few that one task joins them all, in the last round.
LAST_EDGES = 1_000_000


def _trees(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, rank of the root) of the nodes of a partition's edges."""
    batches = [x for x in it if x.num_rows]
    if not batches:
        return
    edges = pa.Table.from_batches(batches)
    both = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).combine_chunks().dictionary_encode()
    codes, nodes = both.indices.to_numpy(), both.dictionary
    rank = np.empty(len(nodes), dtype="int64")
    rank[codes] = np.concatenate([edges["ra"].to_numpy(), edges["rb"].to_numpy()])
    # Nodes by rank, so the least number of a tree is its root.
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(nodes), dtype="int64")
    place[order] = np.arange(len(nodes))
    a, b = place[codes[:edges.num_rows]], place[codes[edges.num_rows:]]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(nxt := root[root], root):
            root = nxt
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    nodes, rank = nodes.take(pa.array(order)), rank[order]
    for i in range(0, len(nodes), 100_000):
        to = root[i:i + 100_000]
        yield pa.record_batch([nodes.slice(i, len(to)), nodes.take(pa.array(to)), pa.array(rank[to])], names=["node", "root", "rank"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) joins to another;
    ``root`` is one node of the component, the same for all of it."""
    ship_package(edges.sparkSession)
    names, turn = None, 0
    kind = edges.schema["a"].dataType.simpleString()
    left = materialize(edges.select("a", "b").filter("a <> b").distinct())
    n = left.count()
    while names is None or n:
        turn += 1
        few = n <= LAST_EDGES
        if few:
            left = left.coalesce(1)
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))
        roots = materialize(left.select("a", "b", rank("a").alias("ra"), rank("b").alias("rb"))
                            .mapInArrow(_trees, f"node {kind}, root {kind}, rank long"))
        if few:
            least, n = roots.select("node", F.col("root").alias("to")), 0
        else:
            least = roots.groupBy("node").agg(F.min(F.struct("rank", "root")).alias("m")).select("node", F.col("m.root").alias("to"))
            left = materialize(roots.join(least, "node").filter("root <> to").select(F.col("root").alias("a"), F.col("to").alias("b")).distinct())
            n = left.count()
        if names is None:
            names = least.withColumnRenamed("to", "root")
        else:
            step = least.withColumnRenamed("node", "root")
            names = materialize(names.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return names
