"""Quality rules: boosted trees over document statistics.

Each whole text is reduced to counts (words, symbols, repeated lines,
repeated five-word windows, capitals, digits); ratios of them are the
features of gradient-boosted trees. The trees are trained here with numpy
on a bounded sample of labelled rows, hold to monotonic constraints on the
features that can only speak against a text, and are flattened into node
arrays, over which a whole batch is scored at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carledger.llm.common import id_remainder, least_rows, ship

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_marks", "n_distinct")
#: Feature and its constraint: -1, the score may not rise with it; 0, free.
FEATURES = (("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeated", -1),
            ("capitals", -1), ("digits", -1), ("marks", -1), ("distinct", 0))
MONOTONE = np.array([m for _, m in FEATURES])

#: Sample of labelled rows of each class that the trees are fitted on.
SAMPLE_ROWS = 4000
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, RIDGE = 40, 3, 0.3, 64, 2.0, 1.0
KEEP = 0.5
#: Rows whose counts are taken together.
BATCH = 256


def _repeated(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in a five-word window found twice or
    more in it. Windows are named exactly: pairs of names get new names."""
    if len(codes) < 5:
        return np.zeros(n_docs, np.int64)
    name = lambda a, b: pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)
    two = name(codes[:-1], codes[1:])
    four = name(two[:-2], two[2:])
    five = name(four[:-1], codes[4:])
    inside = doc[:-4] == doc[4:]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(n_docs, np.int64)
    window = name(five[at], doc[at])
    again = at[np.bincount(window)[window] > 1]
    edge = np.bincount(again, minlength=len(codes) + 5) - np.bincount(again + 5, minlength=len(codes) + 5)
    covered = np.cumsum(edge)[:len(codes)] > 0
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def text_counts(texts: list[str | None]) -> np.ndarray:
    """COUNTS of each text, one row each; null counts as empty."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    names: defaultdict = defaultdict(count().__next__)
    codes, lengths = [], []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        words = b.split()
        own = list(map(names.__getitem__, words))
        codes.append(np.array(own, np.int64))
        lengths.append(len(own))
        lines = [x for x in b.split(b"\n") if x.strip()]
        without = lambda drop, b=b: len(b) - len(b.translate(None, drop))
        out[i] = (len(own), len(t or "") - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)), 0,
                  len(lines), without(UPPER), without(DIGITS), b.count(b"!"), len(set(own)))
    doc = np.repeat(np.arange(len(texts)), lengths)
    out[:, 4] = _repeated(np.concatenate(codes) if codes else np.zeros(0, np.int64), doc, len(texts))
    return out


def features(counts: np.ndarray) -> np.ndarray:
    n = counts.astype(float)
    words, chars, lines = (np.maximum(1.0, n[:, i]) for i in (0, 1, 5))
    return np.stack([np.log1p(n[:, 0]), n[:, 1] / words, n[:, 2] / chars, n[:, 3] / lines, n[:, 4] / words,
                     n[:, 6] / chars, n[:, 7] / chars, n[:, 8] / words, n[:, 9] / words], axis=1)


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in flat arrays. A leaf points at itself on both
    sides, so every row takes DEPTH steps."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def _split(hist_g, hist_h, low, high):
    """Best (gain, feature, bin, left value, right value) of one node's
    histograms, or None. A split whose values break the constraint of its
    feature is not considered; values stay within the node's bounds."""
    g, h = hist_g.cumsum(axis=1), hist_h.cumsum(axis=1)
    total_g, total_h = g[:, -1:], h[:, -1:]
    value = lambda a, b: np.clip(-a / (b + RIDGE), low, high)
    gain_of = lambda a, b, v: -(2 * a * v + (b + RIDGE) * v * v)
    left, right, whole = value(g, h), value(total_g - g, total_h - h), value(total_g, total_h)
    gain = gain_of(g, h, left) + gain_of(total_g - g, total_h - h, right) - gain_of(total_g, total_h, whole)
    bad = (h < LEAST_HESSIAN) | (total_h - h < LEAST_HESSIAN) | (MONOTONE[:, None] * (right - left) < 0)
    gain = np.where(bad, -np.inf, gain)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (gain[f, b], f, b, left[f, b], right[f, b]) if gain[f, b] > 1e-6 else None


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting on the logistic loss over quantile bins. A child's
    value is bounded by the middle of its parent's two sides wherever the
    parent split on a constrained feature, so the constraint holds for the
    whole tree."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, depth, low, high, value):
            me = len(nodes)
            nodes.append([0, np.inf, me, me, RATE * value])
            if depth == DEPTH:
                margin[rows] += RATE * value
                return me
            shape = (x.shape[1], BINS + 1)
            hist_g, hist_h = np.zeros(shape), np.zeros(shape)
            for f in range(x.shape[1]):
                hist_g[f] = np.bincount(binned[rows, f], g[rows], BINS + 1)  # noqa: B023
                hist_h[f] = np.bincount(binned[rows, f], h[rows], BINS + 1)  # noqa: B023
            best = _split(hist_g, hist_h, low, high)
            if best is None or best[2] >= len(cuts[best[1]]):
                margin[rows] += RATE * value
                return me
            _, f, b, lv, rv = best
            goes = binned[rows, f] <= b
            middle = (lv + rv) / 2
            lb, rb = ((middle, high), (low, middle)) if MONOTONE[f] < 0 else ((low, high), (low, high))
            nodes[me][:2] = [f, cuts[f][b]]
            nodes[me][2] = grow(rows[goes], depth + 1, *lb, lv)
            nodes[me][3] = grow(rows[~goes], depth + 1, *rb, rv)
            return me
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, 0.0))
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4],
                 np.array(roots), start)


def _counts_udf():
    schema = ", ".join(f"{c} long" for c in COUNTS)

    @F.pandas_udf(schema)
    def counted(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            yield pd.DataFrame(_in_batches(list(texts)), columns=COUNTS)
    return counted


def _in_batches(texts: list) -> np.ndarray:
    parts = [text_counts(texts[i:i + BATCH]) for i in range(0, len(texts), BATCH)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


HELD_OUT = 4


def train(docs: DataFrame, labels: DataFrame) -> Trees | None:
    """Fits on at most SAMPLE_ROWS rows of each label, chosen by the hash of
    their id; whole texts are counted, and only the counts come to the
    driver. None if there are not two classes."""
    ship(docs.sparkSession)
    given = labels.filter("quality in (0, 1) and doc_id is not null").filter(
        id_remainder(F.col("doc_id"), HELD_OUT) != 2).select("doc_id", "quality")
    some = least_rows(given, "quality", F.xxhash64("doc_id"), SAMPLE_ROWS).dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"])
    got = rows.select("quality", _counts_udf()("text").alias("c")).select("quality", "c.*").toPandas()
    y = got["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    order = np.lexsort(got.to_numpy().T)  # rows arrive in any order
    return fit(features(got[list(COUNTS)].to_numpy())[order], y[order])


def assess(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality_rules`` (COUNTS, base_failed,
    score, kept), which replaces a column of that name. Null and empty texts
    have no words and so fail the base rules; without a model (no labels of
    both classes) every text that passes the base rules is kept. Repeated
    rows are each assessed, an empty table gives an empty one, a very long
    text is counted whole. Rows are read one batch at a time, nothing is
    shuffled."""
    ship(docs.sparkSession)
    schema = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"

    @F.pandas_udf(schema)
    def assessed(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            c = _in_batches(list(texts))
            out = pd.DataFrame(c, columns=COUNTS)
            failed = (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])
            score = model.score(features(c)) if model is not None else np.ones(len(c))
            yield out.assign(base_failed=failed, score=score, kept=~failed & (score >= KEEP))
    return docs.withColumn("quality_rules", assessed(F.col(text)))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: base counts, base_failed, score, kept."""
    found = assess(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", *[F.col(f"quality_rules.{c}").alias(c) for c in COUNTS[:5]],
                        *[F.col(f"quality_rules.{c}").alias(c) for c in ("base_failed", "kept", "score")])
