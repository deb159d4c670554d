"""Packing: exact round trip; mixing: targets, positions, sequential model."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from carledger.llm import mixing, packing

DOC = "doc_id long, text string, source string"


def test_round_robin_is_exact_and_monotone():
    rng = random.Random(1)
    for _ in range(60):
        totals = [rng.choice([0, 1, 5, 333, 10 ** 4]) for _ in range(rng.randint(1, 9))]
        plan = packing.phases(totals, [rng.choice([0.0, 1.0, 2.5]) for _ in totals]) if rng.random() < 0.5 else [totals]
        robin = packing.RoundRobin(plan, 64)
        assert [sum(p[i] for p in plan) for i in range(len(totals))] == totals or not sum(totals)
        c = robin.served(range(robin.total + 1))
        assert (c.sum(axis=1) == np.arange(robin.total + 1)).all() and (np.diff(c, axis=0) >= 0).all()
        assert c[-1].tolist() == totals if robin.total else True
        bounds = [robin.bound(w) for w in range(robin.sequences + 1)]
        sizes = np.diff(bounds)
        assert bounds[-1] == robin.total and all(s == 64 or s & (s - 1) == 0 for s in sizes)
    huge = packing.RoundRobin([[3 * 10 ** 13, 7 * 10 ** 13]])
    assert huge.served([10 ** 14]).tolist() == [[3 * 10 ** 13, 7 * 10 ** 13]]


def untouched():
    """The tokenizer as its library opens it."""
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_ids_are_those_of_the_library():
    rng = random.Random(12)
    bits = ["TEKİ", "***", "&_", "!'s", "%\u0338", "\u0338=", "ǳ", "ª", "ĳ", "İ", "ı", "a", "B", "word", "ẞ", "Σ", "ΟΔΟΣ", "ǅ", "é", "e\u0301", "\u0307", "\u0300", "한", "\u1112\u1161", "日本", "1", "²", "Ⅷ",
            ",", ".", "..", ",.", "'s", "'", "-", " ", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u200b",
            "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "</w>", "�", "🙂", "ﬁ"]
    letters = [chr(c) for c in range(0xC0, 0x530) if chr(c).isalpha()] + [chr(c) for c in range(0x1E00, 0x2000) if chr(c).isalpha()]
    texts = ["".join(rng.choice(bits if rng.random() < 0.8 else letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    tok, own = packing.WordTokenizer(), untouched()
    got = [x for i in range(0, len(texts), 700) for x in tok.encode_batch(texts[i:i + 700])]
    for t, g, e in zip(texts, got, own.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(g, tok.kind).tolist() == e.ids, repr(t)


def test_shares_are_exact_at_any_size():
    rng = random.Random(2)
    for high in (10, 3 * 10 ** 9, 25 * 10 ** 12, 2 ** 52 - 1):
        whole = [rng.randint(1, high) for _ in range(3000)] + [high]
        k, part = ([rng.choice([0, w, rng.randint(0, w)]) for w in whole] for _ in range(2))
        got = packing.share_of(np.array(k), np.array(part), np.array(whole))
        assert got.dtype == np.int64 and got.tolist() == [a * b // w for a, b, w in zip(k, part, whole)]


def docs_of(rng):
    word = lambda: "".join(rng.choice("abcdeé,.'") for _ in range(rng.randint(1, 8)))
    out = [(i, " ".join(word() for _ in range(rng.randint(0, 200))), rng.choice(["a", "a", "a", "b", None])) for i in range(200)]
    return out + [(900, None, "b"), (901, "", "c"), (902, "long text, " * 20000, "a"), (903, "<|endoftext|> x's", "c"),
                  (904, "same row", "a"), (904, "same row", "a"), (None, "no id", None)]


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 4.0}])
def test_round_trip(spark, weights):
    docs = docs_of(random.Random(4))
    rows = spark.createDataFrame([(*d, 7, b"x") for d in docs], DOC + ", part int, ids binary").repartition(5)
    got = packing.pack(rows, weights=weights, length=256).collect()
    own = untouched()
    ids = lambda t: own.encode(t or "", add_special_tokens=False).ids + [2]
    sequences = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or at & (at - 1) == 0
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for i, t, _ in docs:
        want = ids(t)
        parts = sorted(by_doc[i], key=lambda r: (r["start"], r["sequence_id"]))
        copies = sum(d[0] == i for d in docs)
        assert sum(r["length"] for r in parts) == copies * len(want) and all(r["doc_tokens"] == len(want) for r in parts)
        for r in parts:
            assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["start"]:r["start"] + r["length"]]
    if weights is None:
        total = Counter()
        for _, t, s in docs:
            total[s] += len(ids(t))
        whole = sum(total.values())
        for s in sequences.values():
            n, own = sum(r["length"] for r in s), Counter()
            for r in s:
                own[r["source"]] += r["length"]
            assert all(abs(own[k] - n * total[k] / whole) <= 4 for k in total)
    else:
        early = [r for k in range(4) for r in sequences[k]]
        share = Counter()
        for r in early:
            share[r["source"]] += r["length"]
        assert abs(share["b"] / share["a"] - 4) < 0.1
    whole = packing.assemble(spark.createDataFrame(got)).collect()
    assert {r["sequence_id"] for r in whole} == set(sequences)
    for r in whole:
        assert r["ids"] == b"".join(p["ids"] for p in sorted(sequences[r["sequence_id"]], key=lambda p: p["offset"]))


def test_digest_and_empty(spark):
    rows = spark.createDataFrame([(1, "some words here", "a")], DOC)
    r = packing.packed(rows).collect()
    assert sum(x["length"] for x in r) == r[0]["doc_tokens"] and zlib.crc32(b"") == 0
    assert packing.packed(rows.limit(0)).count() == 0


def test_targets_share_the_excess():
    plans = {s: mixing.checked(((0, w), (1, w))) for s, w in zip("abcd", (5, 2, 1, 5))}
    sizes = {"a": 10, "b": 100, "c": 1000, "d": 0}
    t = mixing.targets(sizes, plans, 1110, 3)
    assert t["a"] == 30 and t["b"] == 300 and abs(t["c"] - 780) < 1e-9 and t["d"] == 0
    full = mixing.targets({"a": 10, "b": 5}, {k: plans[k] for k in "ab"}, 1000, 3)
    assert full == {"a": 30.0, "b": 15.0}


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 4.0))
    ts = np.linspace(0, 1, 2001)
    w = np.interp(ts, [k for k, _ in knots], [v for _, v in knots])
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(ts))])
    d = [0.0, 0.01, 0.2, 0.49, 0.51, 0.9, 1.0]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in d], "d double").select(
        mixing.position(F.col("d"), knots).alias("t")).collect()]
    for x, t in zip(d, got):
        assert abs(np.interp(t, ts, area) / area[-1] - x) < 1e-3
    with pytest.raises(ValueError):
        mixing.checked(((0, 0), (1, 0)))


def test_allocation_against_a_sequential_model(spark):
    rng = random.Random(9)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "b", "b", "b", None])) for i in range(400)]
    docs += [(500, None, "a"), (501, "", "b"), (502, "w " * 3000, "c"), (503, "x y", "z"), (503, "x y", "z"), (504, None, "only empty")]
    rows = spark.createDataFrame([(*d, 1.5, 3) for d in docs], DOC + ", position double, size int")
    got = mixing.allocate(rows, schedules=mixing.curriculum).collect()
    again = mixing.allocate(rows.repartition(7), schedules=mixing.curriculum).collect()
    shown = lambda rs: sorted((str(r["row"]["doc_id"]), str(r["row"]["text"])[:9], r["taken"], *r["positions"]) for r in rs)
    assert len(got) == len(docs) and shown(got) == shown(again)
    by = defaultdict(list)
    for r in got:
        n = len((r["row"]["text"] or "").split())
        assert r["size"] == n and r["taken"] == n * len(r["positions"]) <= 3 * n
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        by[r["row"]["source"]].append(r)
    total = sum(r["size"] for r in got)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    plans = mixing.curriculum(names)
    want = mixing.targets({s: sum(r["size"] for r in by[s]) for s in names}, {s: mixing.checked(plans[s]) for s in names}, total, 3)
    for s in names:
        most = max(r["size"] for r in by[s])
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= most
        # Copies in order of position fill the target without gaps.
        copies = sorted((p, r["size"]) for r in by[s] for p in r["positions"])
        done, (a, b) = 0, (plans[s][0][1], plans[s][1][1])
        for p, n in copies:
            if want[s]:
                share = (a * p + (b - a) * p * p / 2) / ((a + b) / 2)
                assert abs(share * want[s] - (done + n / 2)) <= 2 * most + 1e-6
            done += n


def test_mix_rows(spark):
    rows = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], i) for i in range(40)], DOC + ", target long")
    got = mixing.mix(rows, weights={"a": 3.0, "b": 1.0})
    assert got.columns == rows.columns
    n = Counter(r["source"] for r in got.collect())
    assert n["a"] == 30 and n["b"] == 10
    assert mixing.mix(rows.limit(0), weights={"a": 1.0}).count() == 0
    assert mixing.allocation(rows.limit(0)).count() == 0


def test_packing_keeps_the_order_of_training(spark):
    """Mixed rows, dealt anew, come out of packing in the order of training:
    heavy sources fall off over the sequences, queues keep their order."""
    from pyspark.sql import functions as F
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice(("red", "blue", "green")) for _ in range(rng.randint(20, 60))), "abc"[i % 3]) for i in range(600)]
    rows = spark.createDataFrame(docs + [(None, None, "a"), (None, None, "a"), (1000, "", "c")], DOC)
    plans = mixing.curriculum(["a", "b", "c"])
    mixed = mixing.mix(rows, schedules=plans)
    pieces = packing.packed(mixed.repartition(7), schedules=plans, order=F.xxhash64("doc_id", "text")).collect()
    got = defaultdict(Counter)
    for r in pieces:
        got[r["sequence_id"]][r["source"]] += r["length"]
    assert sum(map(lambda c: sum(c.values()), got.values())) == sum(len((r["text"] or "").split()) + 1 for r in mixed.collect())
    last = max(k for k, c in got.items() if sum(c.values()) == packing.SEQUENCE)
    share = lambda w, s: got[w][s] / sum(got[w].values())
    assert last >= 4 and share(0, "a") > share(last, "a") + 0.1 and share(0, "c") < share(last, "c") - 0.05
    whole = [sum(got[w][s] for w in got) for s in "abc"]
    for w in range(last + 1):
        # Tokens up to here are the integral of the schedules.
        upto = [sum(got[v][s] for v in range(w + 1)) for s in "abc"]
        t = np.linspace(0, 1, 4001)
        area = [n * (k[0][1] * t + (k[1][1] - k[0][1]) * t * t / 2) / mixing.schedule_area(k) for n, k in zip(whole, plans.values())]
        at = np.searchsorted(np.sum(area, axis=0), sum(upto))
        assert all(abs(area[i][min(at, 4000)] - upto[i]) < 20 for i in range(3))
    # A document's copies begin in the order of their training positions.
    begin = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        if r["start"] == 0 and r["doc_tokens"] > 1:
            begin[r["source"]].append(r["doc_id"])
    want = defaultdict(list)
    for r in mixing.allocate(rows, schedules=plans).collect():
        if r["size"]:
            want[r["row"]["source"]] += [(p, r["row"]["doc_id"]) for p in r["positions"]]
    assert dict(begin) == {s: [i for _, i in sorted(v)] for s, v in want.items()}


def test_phases_of_schedules():
    plan = packing.scheduled([1000, 10 ** 12, 77, 0], [((0, 1), (0.5, 0), (1, 0)), ((0, 1), (1, 3)), None, ((0, 1), (1, 1))])
    assert [sum(p[i] for p in plan) for i in range(4)] == [1000, 10 ** 12, 77, 0] and plan[-1] == [0, 0, 77, 0]
    assert all(n >= 0 for p in plan for n in p)
    assert packing.scheduled([], []) == []


def test_any_number_of_sources(spark):
    docs = [(i, "red blue " * (1 + i % 5), f"site{i % 700:03}.org") for i in range(1500)] + [(5000, "red", None)]
    rows = spark.createDataFrame(docs, DOC).repartition(3)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    plans = mixing.curriculum(names)
    want = mixing.targets(dict(sizes), {s: mixing.checked(k) for s, k in plans.items()}, sum(sizes.values()), 3)
    got = mixing.allocate(rows, schedules=mixing.curriculum).collect()
    assert len(got) == len(docs) and all(abs(r["target"] - want[r["row"]["source"]]) < 1e-6 for r in got)
    tokens = Counter()
    for _, t, s in docs:
        tokens[s] += len(t.split()) + 1
    for how in ({}, {"schedules": plans}):
        pieces = packing.pack(rows, length=1024, **how).collect()
        own, fill = Counter(), defaultdict(list)
        for r in pieces:
            own[r["source"]] += r["length"]
            fill[r["sequence_id"]].append((r["offset"], r["length"]))
        assert own == tokens
        for s in fill.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at == 1024 or at & (at - 1) == 0
    # Same halving as over a list of all sources.
    robin = packing.RoundRobin([[tokens[s] for s in names]], 1024)
    c = robin.served([robin.bound(w) for w in range(robin.sequences + 1)])
    want = {(s, w): int(n) for w, row in enumerate(np.diff(c, axis=0)) for s, n in zip(names, row) if n}
    got = Counter()
    for r in packing.pack(rows, length=1024).collect():
        got[r["source"], r["sequence_id"]] += r["length"]
    assert got == want
