"""The corpus pipeline against a plain program, stage by stage."""

import os
import re
import sys
from collections import defaultdict

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_plain_programs(spark):
    import corpus_pipeline as CP
    from carledger.llm import langid, mixing, packing
    from carledger.llm.common import id_remainder, stage, table
    from test_line_dedup import plain
    from test_similarity import shingle_set, union
    assert [n for n, _ in CP.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    docs = table(spark, SF, "documents")
    docs = docs.union(spark.createDataFrame([(9000, None, "en", "src0", 0), (9001, "", None, None, 0), (9002, "12 34", "en", "src1", 5)], docs.schema))
    out = [docs]
    for name, f in CP.STAGES:
        out.append(stage(f(spark, out[-1], SF), f"test-{name}"))
    for d in out[1:5]:
        assert d.columns == docs.columns and [t for _, t in d.dtypes] == [t for _, t in docs.dtypes]
    start, lang, lines, one, mixed, packs = [d.collect() for d in out]

    model = langid.train(docs.filter(id_remainder(docs["doc_id"], langid.HELD_OUT) != 0))
    names, z = [k for k, _ in model.dictionaries], model.compressors()
    assert sorted(r["doc_id"] for r in lang) == sorted(r["doc_id"] for r in start if not langid.classify(r["text"], names, z)[3])
    assert len(lang) >= 0.95 * len(start) - 3

    want = plain([(r["doc_id"], r["text"]) for r in lang])
    word = lambda t: re.search(r"[^\x20\x09-\x0D]", t)
    assert sorted((r["doc_id"], r["text"]) for r in lines) == sorted(
        (k[0], t) for k, (t, n) in want.items() if not n or word(t))
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    sets = {r["doc_id"]: shingle_set(r["text"]) for r in lines}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union(ids, pairs)
    assert sorted(r["doc_id"] for r in one) == sorted(set(root.values()))

    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    held, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in one:
        held[r["source"]] += size(r)
        most[r["source"]] = max(most[r["source"]], size(r))
    for r in mixed:
        taken[r["source"]] += size(r)
    sources = sorted(held)
    goal = mixing.targets(dict(held), {s: mixing.checked(k) for s, k in mixing.curriculum(sources).items()}, sum(held.values()), 3)
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in sources)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in one}

    tok = packing.WordTokenizer()
    n = sum(len(x) // np.dtype(tok.kind).itemsize + 1 for x in tok.encode_batch([r["text"] for r in mixed]))
    assert sum(r["length"] for r in packs) == n
    fill = defaultdict(int)
    for r in packs:
        fill[r["sequence_id"]] += r["length"]
    assert all(v == 4096 or v & (v - 1) == 0 for v in fill.values())


def test_stages_on_awkward_tables(spark):
    """An empty table; repeated rows, null ids and columns with names that
    the stages use themselves."""
    import corpus_pipeline as CP
    from carledger.llm.common import stage, table
    docs = table(spark, SF, "documents")
    some = docs.orderBy("doc_id").limit(30)
    odd = some.union(some.limit(3)).union(some.limit(2).selectExpr("cast(null as long)", "concat(text, ' without id')", "lang", "source", "n_chars"))
    odd = odd.selectExpr("*", "1 as row", "'x' as lang_id", "2 as n_removed", "3.0 as position", "4 as h", "5 as size", "6 as _key", "'y' as component")
    for start in (docs.limit(0), odd):
        d = start
        for i, (name, f) in enumerate(CP.STAGES):
            d = stage(f(spark, d, SF), f"test-{name}")
            assert i == 4 or d.columns == start.columns
            n = d.count()
            assert n == 0 if start is not odd else n > 0


def test_run_and_registration(spark):
    import __spark_entry__ as E
    import corpus_pipeline as CP
    q = E.queries()
    assert all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 14)) and q["pipeline"] is CP.run
    got = CP.run(spark, SF)
    assert "doc_id" in got.columns and got.count() > 0
    assert np.all([r["length"] > 0 for r in got.select("length").collect()])


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_warc", "op6_pq_near_dedup", "op10_ngram_join", "op13_collocations"])
def test_against_sql(spark, name):
    sys.path.insert(0, ROOT)
    from tools import check_oracle
    ok, message = check_oracle.compare(spark, SF, [name], verbose=False)[name]
    assert ok, message
