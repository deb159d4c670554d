"""Collocations, token counts and whitening against plain programs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from carledger.llm import collocations, token_counts, whitening
from carledger.session import shared_path


# ------------------------------------------------------------- collocations

def brute(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    rows = []
    for p, a in found.items():
        lang, w = p[0], p[1:]
        if any(len(q) > len(p) and q[0] == lang and 100 * b >= 50 * a and any(q[1 + i:1 + i + len(w)] == w for i in range(len(q)))
               for q, b in found.items()):
            continue
        cuts = [(10 ** 6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        rows.append((lang, -s, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    out = []
    for lang in {r[0] for r in rows}:
        for i, (_, s, a, p, left, right) in enumerate(sorted(r for r in rows if r[0] == lang)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(rng, n):
    word = lambda: rng.choice(["the", "of", "New", "york", "city", "é", "a-b", "x" * 30, "ÅB"]) if rng.random() < 0.7 else f"w{rng.randint(0, 30)}"
    passage = ", ".join(" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(30))
    out = []
    for i in range(n):
        t = "".join(word() + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", " !? "]) for _ in range(rng.choice([0, 1, 2, 3, 50, 300])))
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), t + passage if rng.random() < 0.3 else t))
    return out + [("en", None), ("en", ""), ("de", " .\n"), (None, "new york " * 9000), ("en", "a b c d e " * 700)]


@pytest.mark.parametrize("period, longest", [(48, 4096), (2, 7), (1, 3)])
def test_collocations_against_brute_force(spark, monkeypatch, period, longest):
    monkeypatch.setattr(collocations, "PERIOD", period)
    monkeypatch.setattr(collocations, "LONGEST", longest)
    monkeypatch.setattr(collocations, "TASK_KEYS", 500)
    docs = texts(random.Random(period), 150)
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "lang string, text string, phrase string, freq int").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(df, least=5, top=60).collect())
    assert got == brute(docs, 5, 60) and len(got) > 100


def test_collocations_cut_every_text_whole():
    rng = random.Random(3)
    for _ in range(100):
        run = collocations.Run([collocations.normal(t) for _, t in texts(rng, 6)])
        text, first, stop, last = collocations.chunks(run)
        seen = np.zeros(len(run.words), int)
        for a, b, end in zip(first, stop, last):
            seen[a:b if end else b - collocations.OVERLAP] += 1
        assert (seen == 1).all()


def test_collocations_without_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    few = spark.createDataFrame([("en", "one two three"), (None, None)], "lang string, text string")
    assert collocations.mine(none).count() == collocations.mine(few).count() == 0


def test_words_are_counted_once(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([("en", f"word{i} follows") for i in range(40)], "lang string, text string")
    words, salt = collocations.word_counts(collocations.dictionary(docs))
    assert salt == 0 and words.count() == 41 and words.agg(F.sum("f")).first()[0] == 80


# ------------------------------------------------------------- token counts

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(spark, monkeypatch, name):
    import public_tokenizers
    monkeypatch.setattr(token_counts, "PIECE", 50)
    rng = random.Random(8)
    bits = ["a", "é", " ", "  ", "\n", "don't ", "<|endoftext|>", "<|startoftext|>", "12 ", "x y", "İ,", "̈", "日本", " \t", "I'll go. "]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "long text " * 60000), (903, docs[5][1]), (903, docs[5][1]), (None, docs[5][1]), (None, "no id"), (None, "no id")]
    if name.endswith("model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    df = spark.createDataFrame([(*d, 5, b"x") for d in docs], "doc_id long, text string, n_tokens int, digest binary").repartition(4)
    cache = shared_path(spark, "cache")
    got = token_counts.count(df, cache, name)
    shown = lambda rows: sorted((str(r[0]), *r[1:]) for r in rows)
    want = shown((i, len((t or "").encode()), size(t or ""), size(t or "") > 1024) for i, t in docs)
    assert shown(tuple(r) for r in got.collect()) == want
    # Every distinct text was stored once, and nothing is encoded again.
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in docs})
    monkeypatch.setattr(token_counts, "encode", lambda *a: pytest.fail("all texts are known"))
    assert shown(tuple(r) for r in token_counts.count(df, cache, name).collect()) == want


def test_only_misses_are_appended(spark):
    cache = shared_path(spark, "cache")
    first = spark.createDataFrame([(1, "one text"), (2, "two texts")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "two texts"), (5, "third"), (6, "third")], "doc_id long, text string")
    token_counts.count(first, cache).collect()
    # Counts of another version are of no use here.
    spark.createDataFrame([(b"x", 7, "other")], token_counts.CACHE).write.mode("append").partitionBy("version").parquet(cache)
    got = sorted(tuple(r) for r in token_counts.count(second, cache, limit=1).collect())
    assert [r[0] for r in got] == [1, 5, 6] and got[0][3] and got[1][2] == got[2][2]
    assert spark.read.parquet(cache).count() == 4
    assert token_counts.count(first.limit(0), cache).count() == 0 and spark.read.parquet(cache).count() == 4
    assert token_counts.count(first.limit(0), shared_path(spark, "none")).count() == 0


# ---------------------------------------------------------------- whitening

def test_leading_pairs_against_lapack():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 40):
        for rank in (1, 2, n):
            b = rng.standard_normal((n, min(rank, n))) * 10.0 ** rng.integers(-3, 4)
            v = b @ b.T
            values, vectors = whitening.leading_pairs(v, 4)
            want = np.linalg.eigvalsh(v)[::-1][:min(4, min(rank, n))]
            assert len(values) == len(want) and np.allclose(values, want, rtol=1e-10, atol=1e-13 * want[0])
            assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
            assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-12 * want[0]
    # Tied and nearly tied eigenvalues, blocks that do not touch, scales.
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for values in ([5, 5, 5, 5, 5, 1], [5, 5 - 1e-9, 5 - 2e-9, 4], [1, 1e-4, 1e-8, 1e-9], [3, 3, 2, 2]):
        full = np.array([*values, *[0.0] * (30 - len(values))]) * 1e7
        for basis in (q, np.eye(30)):
            e, x = whitening.leading_pairs(basis @ np.diag(full) @ basis.T, 4)
            assert np.allclose(e, full[:4], rtol=1e-6) and np.abs(x @ x.T - np.eye(4)).max() < 1e-12


def model(vectors):
    """Distinct integer vectors and their whitening, by LAPACK."""
    x = np.array(sorted({tuple(np.floor(np.float64(256) * np.array(v, np.float32).astype(float)).astype(int)) for v in vectors}))
    v = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], x.shape[1])
    e, axes = np.linalg.eigh(v)
    return x, e[::-1][:4], axes.T[::-1][:4], np.trace(v)


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 8)) * np.array([9, 5, 3, 2, 1, 1, .5, .1])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[3][1])]
    rows += [(2000, None), (2001, [None] + [1.0] * 7), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2004, [])]
    rows += [(3000 + i, [float(i), 1.0]) for i in range(5)] + [(4000, [2.5])]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "vec_id long, embedding array<float>, n int, component string").repartition(4)
    got = whitening.whiten(df).collect()
    x, e, axes, trace = model([v for _, v in rows[:502]])
    sums, n = x.sum(axis=0), len(x)
    own = {k: v for k, v in rows[:502] if k is not None}
    long = [r for r in got if r["vec_id"] is None or r["vec_id"] < 2000]
    assert len(long) == 4 * 502 and {r["n"] for r in long} == {300}
    sign = {}
    for r in long:
        v = own.get(r["vec_id"], rows[3][1])
        y = np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)
        c = r["component"] - 1
        w = (y - sums / n) @ axes[c] / np.sqrt(e[c])
        s = sign.setdefault(c, np.sign(w * r["whitened"]))
        assert abs(s * w - r["whitened"]) < 1e-9
        assert r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(y, sums)) == int(r["deviation_digits"])
        assert abs(r["explained"] * trace / e[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
    short = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"])) for r in got if r["vec_id"] is not None and r["vec_id"] >= 2000)
    assert [r[:4] for r in short] == [(3000 + i, 1, 5, (5 * 256 * (i - 2)) ** 2) for i in range(5)]
    assert whitening.whiten(df.limit(0)).count() == 0
    # Equal vectors alone do not vary; two distinct ones do along one axis.
    same = df.filter("vec_id = 4000 or vec_id >= 1000 and vec_id < 1005")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.union(df.filter("vec_id is null"))).count() == 6


def test_sums_and_deviations_are_exact():
    rng = np.random.default_rng(6)
    for high in (300, 2 ** 19, 2 ** 62):
        x = rng.integers(-high, high, (50, 7))
        for n, total in ((3, [5, -7, 0, 1, -1, 2, 9]), (10 ** 11, [int(v) * 10 ** 9 for v in rng.integers(-high, high, 7)])):
            want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, total)) for r in x]
            assert whitening.deviations(x, n, total) == want
    assert whitening.integers(np.array([1e300, -1e300, -0.001, 0.5])).tolist() == [2 ** 63 - 1, -2 ** 63, -1, 128]
