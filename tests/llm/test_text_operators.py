"""Language ID, PII, quality rules and the quality net: brute force, held-out
accuracy, and rows that are null, empty, long, repeated or oddly named."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from carledger.llm import langid, pii, quality_net, quality_rules
from carledger.llm.common import table

SF = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@has_data
def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.predictions(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in got) / len(got) < 0.02


def test_language_odd_rows(spark):
    train = [(1, "the cat and the dog " * 9, "en", "s", 0), (2, "der hund und die katze " * 9, "de", "s", 0),
             (3, None, "en", "s", 0), (4, "the house", None, "s", 0)]
    model = langid.train(spark.createDataFrame(train, DOC))
    assert {k for k, _ in model.dictionaries} == {"en", "de"}
    odd = [(1, None), (2, ""), (3, "123 !? ²"), (4, "the dog and the cat"), (4, "the dog and the cat"), (5, "die katze " * 50000)]
    rows = spark.createDataFrame([(i, t, "mine") for i, t in odd], "doc_id long, text string, lang_id string")
    got = [(r["doc_id"], r["lang_id"]["lang"], r["lang_id"]["rejected"]) for r in langid.identify(rows, model).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en", "de"]
    assert all(g[2] for g in got[:3]) and not got[5][2]
    none = spark.createDataFrame([], DOC)
    assert langid.train(none).dictionaries == () and langid.keep_identified(none).count() == 0
    only = langid.train(spark.createDataFrame(train[:1], DOC))
    assert langid.classify("the dog", ["en"], only.compressors())[:2] == ("en", 1.0)
    with pytest.raises(ValueError):
        many = spark.range(300).selectExpr("id doc_id", "'some words' text", "cast(id as string) lang")
        langid.train(many)


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_equals_plain_patterns():
    rng = random.Random(5)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.2.3", "007.1.1.1", ".5.6.7.8", "4111 1111 1111 1111", "4111-1111", " ", "+1 (555) 123-4567",
            "+1+2", "é", "\n", "12", "-", "+", "4" * 16, "1.1.1.1.1.1.1.1", "q@w.e@r.t", "%@-.-", "😀", "0" * 13]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        got = [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS]
        assert got == base_spans(t), t


def test_pii_validators_context_and_long_texts():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("Konto DE89 3704 0044 0532 0130 00 UND MEHR") == ["iban"]
    assert kinds("Konto DE88 3704 0044 0532 0130 00") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    near = pii.find_spans("pay by visa card 4111111111111111")[0]
    far = pii.find_spans("order serial 4111111111111111")[0]
    assert near[0] == far[0] == "card" and near[3] > far[3]
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 60_000, "A1B2" * 50_000):
        pii.find_spans(run)


def test_pii_rows(spark):
    rows = spark.createDataFrame([(1, "to a.b@c.de now", "x"), (1, "to a.b@c.de now", "x"), (2, None, "y"), (3, "", "z")],
                                 "doc_id long, text string, pii string")
    got = pii.report(rows).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["doc_id"], r["n_email"], r["spans"]) for r in got] == [(1, 1, "email:3:11")] * 2 + [(2, 0, ""), (3, 0, "")]
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:3:11").hexdigest() and got[2]["base_sha256"] == empty
    assert [r["text"] for r in pii.redact(rows).collect()] == ["to [email] now"] * 2 + [None, ""]
    assert pii.report(spark.createDataFrame([], DOC)).count() == 0


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)]


def test_rule_counts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x\nx\n\n x\nx", "é\xa0ü # $|\x85<", "w " * 5000]
    texts += [" ".join(rng.choice("abc\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert quality_rules.text_counts(texts)[:, :5].tolist() == [plain_counts(t) for t in texts]


def test_trees_fit_and_hold_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    y = ((x[:, 2] < 0.6) & (x[:, 5] < 0.8) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality_rules.fit(x, y)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.9
    for f, (_, m) in enumerate(quality_rules.FEATURES):
        steps = np.repeat(x[:50], 40, axis=0)
        steps[:, f] = np.tile(np.linspace(-0.2, 1.2, 40), 50)
        s = trees.score(steps).reshape(50, 40)
        if m < 0:
            assert (np.diff(s, axis=1) <= 1e-12).all()

    def walk(t, row):
        while trees.left[t] != t:
            t = trees.left[t] if row[trees.feature[t]] <= trees.threshold[t] else trees.right[t]
        return trees.value[t]
    one = [1 / (1 + np.exp(-(trees.start + sum(walk(r, row) for r in trees.roots)))) for row in x[:100]]
    assert np.allclose(one, trees.score(x[:100]))


@has_data
def test_rules_and_net_against_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality_rules.verdicts(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        n, _, _, _, repeated = plain_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and (not r["kept"] or not r["base_failed"])
    unseen = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and not r["base_failed"]]
    assert sum(r["kept"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.95
    net = {r["doc_id"]: r for r in quality_net.scores(docs, labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in net.values())
    held = [i for i in truth if net[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert sum(net[i]["predicted"] == truth[i] for i in held) / len(held) > 0.9


def test_rules_and_net_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "ten good words " * 40, 1), (3, "ten good words " * 40, 1)],
                                 "doc_id long, text string, quality_rules int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.verdicts(rows, none).collect()
    assert [r["kept"] for r in got] == [False] * 4 and [r["n_words"] for r in got] == [0, 0, 120, 120]
    assert quality_net.train(rows, none) is None
    assert [r["score"] for r in quality_net.scores(rows, none).collect()] == [0.5] * 4
    nothing = spark.createDataFrame([], DOC)
    assert quality_rules.verdicts(nothing, none).count() == quality_net.scores(nothing, none).count() == 0


def test_net_reads_the_whole_text():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(rng.integers(5, 80))) for _ in range(150)]
    bad = [" ".join(word() + "###" for _ in range(rng.integers(5, 80))) for _ in range(150)]
    net = quality_net.fit([t.encode() for t in good + bad], np.array([1.0] * 150 + [0.0] * 150, np.float32), passes=6)
    p = quality_net.probabilities(net, [good[0].encode(), bad[0].encode(), b"", (good[1] * 3000).encode()])
    assert p[0] > 0.7 > p[1] and 0 <= p[2] <= 1 and p[3] > 0.7
    clean, tail = (good[2] + " ") * 60, " ".join(bad[:20])
    mixed = quality_net.probabilities(net, [clean.encode(), (clean + tail).encode()])
    assert mixed[1] < mixed[0]
    # Blocks overlap by the filters' width, so every byte is seen by every filter position.
    b = quality_net.blocks_of(bytes(range(1, 251)))
    assert b.shape == (2, quality_net.BLOCK + quality_net.WIDTH - quality_net.STEP) and b[0, -1] == b[1, 5]


def test_language_is_that_of_a_plain_loop(spark):
    """Dictionaries from whole texts and classes, by zstandard alone."""
    import re
    from collections import Counter

    import zstandard as zstd

    from carledger.llm import langid
    rng = random.Random(5)
    words = {k: [("".join(rng.choice(a) for _ in range(rng.randint(2, 9)))) for _ in range(400)]
             for k, a in {"aa": "abcdeé", "bb": "defghi", "cc": "ghijkß"}.items()}
    make = lambda k, n: " ".join(rng.choice(words[k]) + rng.choice(["", ",", ".", " 7"]) for _ in range(n))
    docs = [(i, make(k, rng.choice([3, 40, 3000])), k) for i, k in enumerate(["aa"] * 9 + ["bb"] * 7 + ["cc"] * 5)]
    docs += [(50, None, "aa"), (51, "", "bb"), (52, "123 !", "cc"), (53, make("aa", 5) + " " + make("bb", 5), None), (54, docs[0][1], "aa")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    flat = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    content = {}
    for k in words:
        n = Counter(w for t in {t for _, t, lang in docs if lang == k and t} for w in flat(t).split())
        own, size = [], 0
        for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0])):
            size += len(w.encode()) + 1
            if size > langid.DICT_BYTES:
                break
            own.append(w)
        content[k] = " ".join(reversed(own)).encode()
    model = langid.train(df)
    assert dict(model.dictionaries) == content
    tools = {k: zstd.ZstdCompressor(level=langid.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False,
                                    dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT)) for k, c in content.items()}
    for r in langid.identify(df, model).collect():
        t = flat(r["text"] or "")
        if not t:
            assert r["lang_id"]["lang"] == "und" and r["lang_id"]["rejected"]
            continue
        sizes = {}
        for k, z in tools.items():
            b = t.encode()
            parts = [b[i:i + 512] for i in range(0, len(b), 512)]
            parts = [p if len(p) >= 96 else b" ".join([p] * max(4, -(-96 // len(p)))) for p in parts]
            sizes[k] = sum(len(z.compress(p)) for p in parts)
        low = sorted(sizes.values())
        if low[0] < low[1]:
            assert r["lang_id"]["lang"] == min(sizes, key=sizes.get)
        assert r["lang_id"]["rejected"] == ((low[1] - low[0]) / low[0] < langid.MIN_MARGIN)
