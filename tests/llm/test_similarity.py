"""N-gram join, PQ near-dedup and components against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from carledger.llm import ngram_join, pq_dedup
from carledger.llm.common import connected, least_rows


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_copies(rng, n):
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    passage = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([3, 20, 60, 200]))]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.choice([1, 1, 1, 2, 5, 40])):
            copy = [word() if rng.random() < rng.choice([0, 0.005, 0.02, 0.05]) else w for w in base]
            out.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in copy))
    return out[:n]


def test_ngram_join_against_brute_force(spark, monkeypatch):
    # Small parts and rounds, so that all steps take part.
    monkeypatch.setattr(ngram_join, "HUBS", 3)
    rng = random.Random(6)
    docs = list(enumerate(near_copies(rng, 500), 10))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b c"), (1004, "A B\tC"), (1005, "a b c d e"), (1006, "É x y z w"),
             (1007, "é x y z w"), (1008, "word " * 30000), (1009, docs[0][1]), (1009, docs[0][1]), (None, docs[0][1]), (3, "a\x85b c d e f")]
    rows = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n int, node string").repartition(6)
    sets = [shingle_set(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union(range(len(docs)), pairs)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((str(i), len(sets[k]), str(least.get(root[k]))) for k, (i, _) in enumerate(docs))
    got = ngram_join.groups(rows).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    kept = ngram_join.keep_one(rows)
    assert kept.columns == rows.columns
    ids = [r["doc_id"] for r in kept.collect()]
    full = {least[root[k]] for k, (i, _) in enumerate(docs) if sets[k]}
    assert sorted(ids) == sorted(full | {1000, 1001, 1002})


def test_ngram_join_without_rows_or_links(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.groups(none).count() == ngram_join.keep_one(none).count() == 0
    alone = spark.createDataFrame([(1, None), (2, ""), (3, "only one text")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.groups(alone).collect()) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


@pytest.mark.parametrize("linked", [True, False])
def test_keep_one_of_documents_without_id(spark, linked):
    text = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    docs = [(None, text(k)) for k in range(8)] + [(None, text(0)), (None, None), (None, ""), (7, text(20)), (8, text(21))]
    want = [text(k) for k in range(8)] + [None, "", text(20), text(21)]
    if linked:
        # A near copy without id of one without id, and of one with an id.
        docs += [(None, text(30, 60)), (None, text(30, 58)), (9, text(40, 60)), (None, text(40, 58))]
        want += [text(40, 60)]
    kept = [r["text"] for r in ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()]
    if linked:
        assert len({text(30, 60), text(30, 58)} & set(kept)) == 1
        kept = [t for t in kept if t not in (text(30, 60), text(30, 58))]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_prefixes_share_enough():
    """Every linked pair shares the shingles that the pair rule asks for,
    whatever the levels."""
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 14, 1 << ngram_join.COUNTER_BITS).astype(np.uint8)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2))
        keep = rng.random(len(x)) > rng.choice([0, 0.02, 0.1, 0.15])
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 2 ** 63, int(rng.integers(0, 20))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        (p, _, a), (q, _, b) = ngram_join.prefix(x, levels), ngram_join.prefix(y, levels)
        o = math.ceil((len(x) + len(y)) * 80 / 180)
        need = o + min(a - ngram_join.needed(len(x)), b - ngram_join.needed(len(y)))
        assert len(np.intersect1d(p, q)) >= need >= 1


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 90)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    ring = [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    edges = chain + star + ring + [(5, 5), (1, 0)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union({n for e in edges for n in e}, edges)
    assert set(got) == set(want)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(got) == groups(want)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows):
    ok = lambda e, l: l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    pairs = []
    for i, (_, e, l) in enumerate(rows):
        for j in range(i):
            f, m = rows[j][1], rows[j][2]
            if ok(e, l) and ok(f, m) and l == m and len(e) == len(f):
                a, b = np.array(e, np.float32).astype(float), np.array(f, np.float32).astype(float)
                if (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= 0.93:
                    pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("block", [8192, 16])
def test_pq_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    monkeypatch.setattr(pq_dedup, "CHUNK", block)
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for _ in range(60):
        base = rng.standard_normal(16)
        for _ in range(int(rng.choice([1, 2, 6]))):
            v = base + rng.standard_normal(16) * rng.choice([0, 0.1, 0.25])
            rows.append((i, [float(x) for x in v], int(rng.integers(0, 2))))
            i += 1
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0),
             (905, [float("inf")] + [1.0] * 15, 0), (906, rows[0][1], None), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0)]
    rows += [(910 + k, rows[0][1], rows[0][2]) for k in range(40)] + [(910, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2])]
    rows.append((990, [x * 7 for x in rows[0][1]], rows[0][2]))
    pairs = brute_links(rows)
    root, n = union(range(len(rows)), pairs), defaultdict(int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(r[0], least.get(root[k], r[0]))
    want = sorted((str(r[0]), n[k], str(least.get(root[k])), r[0] == least.get(root[k])) for k, r in enumerate(rows))
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in pq_dedup.links(df).collect())
    assert got == want
    assert pq_dedup.links(df.limit(0)).count() == 0


def test_probes_and_distances_lose_nothing():
    """Recall against brute force is 1: both bounds hold for every pair."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24))
    x[::3] = x[1::3] + rng.standard_normal((500, 24)) * 0.2
    unit = x / np.sqrt((x ** 2).sum(1))[:, None]
    book = pq_dedup.fit(unit[:400], 12)
    own, codes, missed, probes = pq_dedup.encode(book, unit)
    q, r = pq_dedup.matches(book, x, probes, x, own, codes, missed)
    assert set(zip(q.tolist(), r.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(unit @ unit.T >= 0.93))))


def test_a_dense_block_is_counted_in_slices(monkeypatch):
    """4,096 vectors that all link: sixteen million pairs, counted without
    ever being held together."""
    import tracemalloc
    rng = np.random.default_rng(8)
    x = np.ones((4096, 16)) + rng.standard_normal((4096, 16)) * 0.01
    unit = x / np.sqrt((x ** 2).sum(1))[:, None]
    book = pq_dedup.fit(unit[:500], 2)
    own, codes, missed, probes = pq_dedup.encode(book, unit)
    n, largest = np.zeros(4096, np.int64), 0
    tracemalloc.start()
    for q, r in pq_dedup.slices(book, x, probes, x, own, codes, missed):
        np.add.at(n, q, 1)
        largest = max(largest, len(q))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n == 4096).all() and largest <= pq_dedup.PAIRS and peak < 300e6


def test_vectors_of_many_lengths(spark):
    rows = [(10 * d + k, [1.0 + k / 100] * d, 0) for d in range(1, 281) for k in range(2)]
    got = pq_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == 560 and all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] // 10 * 10 for r in got)


def test_least_rows_is_bounded_and_repeats(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 5 as string)) as k")
    pick = lambda d: sorted(tuple(r) for r in least_rows(d, "k", F.xxhash64("id"), 20).collect())
    got = pick(df)
    assert got == pick(df.repartition(9)) and {k for k, _ in got} == {"hot", "0", "1", "2", "3", "4"}
    assert all(sum(k == x for k, _ in got) == 20 for x in {"hot", "0", "1", "2", "3", "4"})
