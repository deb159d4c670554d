"""Line dedup against a plain program."""

import random
import re

from carledger.llm import linededup


def plain(docs):
    """{key: (text, removed)} by the definition; docs: (doc_id, text)."""
    seen, gone = {}, {}
    for i, t in sorted({d for d in docs if d[1] is not None}):
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        for k in range(len(lines) - 2):
            w = tuple(x for _, x in lines[k:k + 3])
            if w in seen:
                gone.setdefault((i, t), set()).update(n for n, _ in lines[k:k + 3])
            seen.setdefault(w, (i, k))
    return {d: ("\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone.get(d, ())), len(gone.get(d, ())))
            if d[1] is not None else (None, 0) for d in docs}


def test_against_plain_program(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "long line of words"]) for _ in range(rng.randint(0, 9))))
            for i in range(120)]
    docs += [(500, None), (501, ""), (502, "x\ny\nz"), (503, "x\ny\nz"), (503, "x\ny\nz"), (504, "p\nx\ny\nz\nq"),
             (505, "l\n" * 4000), (506, "one\r\ntwo\r\nthree")]
    rows = spark.createDataFrame([(*d, "other") for d in docs], "doc_id long, text string, n_removed string")
    want = plain(docs)
    got = linededup.remove_repeats(rows).collect()
    assert len(got) == len(docs)
    for d, r in zip(sorted(docs, key=str), sorted(got, key=lambda r: str((r["doc_id"], r["text"])))):
        assert r["doc_id"] in dict(docs)
    assert sorted((r["doc_id"], str(r["text"]), r["n_removed"]) for r in got) == \
        sorted((d[0], str(want[d][0]), want[d][1]) for d in docs)
    kept = {r["doc_id"] for r in linededup.drop_repeats(rows.drop("n_removed")).collect()}
    assert 503 not in kept and {500, 501, 502, 504} <= kept
    empty = rows.limit(0)
    assert linededup.remove_repeats(empty).count() == 0


def test_every_removed_line_stays_somewhere(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "x\na\nb\ne"), (4, "a\na\na\na\na")]
    got = linededup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    left = {x for r in got for x in r["text"].split("\n")}
    assert left >= {x for _, t in docs for x in t.split("\n")}
    assert next(r["text"] for r in got if r["doc_id"] == 4) == "a"
