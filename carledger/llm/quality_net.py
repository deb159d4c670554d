"""Quality classifier: a convolutional network over bytes, in numpy.

Every byte has a learned vector. Learned filters of WIDTH bytes run over the
whole text at a step of STEP; their responses are max-pooled over chunks of
two blocks, each chunk overlapping the next by one block, from the first byte
to the last. A small layer reads each chunk, its mean and maximum over all
chunks make the text's vector, and a logistic unit turns that into one
probability. The network is trained here on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carledger.llm.common import id_remainder, least_rows, ship

WIDTH, STEP, VECTOR, FILTERS, HIDDEN = 8, 2, 8, 48, 16
#: Bytes of a block; a chunk is two blocks.
BLOCK = 128
#: Training: rows of each label, bytes of a row that a step shows (a passage
#: drawn anew from the whole text each time), passes, rows of a step, rate.
SAMPLE_ROWS, SHOWN_BYTES, PASSES, STEP_ROWS, RATE = 2000, 1536, 10, 32, 0.004
#: A row of label 1 is cut to a short passage this often: a passage of a good
#: text is good, and short texts are rare in the sample.
SHORTENED = 0.3
THRESHOLD = 0.7
HELD_OUT = 4

Net = dict[str, np.ndarray]


def blocks_of(text: bytes) -> np.ndarray:
    """Bytes in rows of BLOCK and the beginning of the next, zeros after the end."""
    n = max(1, -(-len(text) // BLOCK))
    flat = np.zeros(n * BLOCK + WIDTH - STEP, np.uint8)
    flat[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, BLOCK + WIDTH - STEP)[::BLOCK]


def _windows(net: Net, blocks: np.ndarray) -> np.ndarray:
    """(block, window, WIDTH * VECTOR)"""
    x = net["bytes"][blocks].reshape(len(blocks), -1)
    view = np.lib.stride_tricks.sliding_window_view(x, WIDTH * VECTOR, axis=1)
    return view[:, ::STEP * VECTOR]


def _chunks(best: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Chunks of consecutive blocks of one text (one chunk for one block):
    pooled responses, text of each chunk, first and second block of each."""
    n = np.maximum(1, size - 1)
    text = np.repeat(np.arange(len(size)), n)
    a = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    b = np.where(np.repeat(size, n) > 1, a + 1, a)
    return np.maximum(best[a], best[b]), text, a, b


def _pool(z: np.ndarray, text: np.ndarray, n: int):
    start = np.searchsorted(text, np.arange(n))
    many = np.bincount(text, minlength=n)[:, None]
    return np.add.reduceat(z, start) / many, np.maximum.reduceat(z, start)


def _responses(net: Net, blocks: np.ndarray) -> np.ndarray:
    """Best response of every filter in every block, some blocks at a time."""
    out = np.empty((len(blocks), FILTERS), np.float32)
    for i in range(0, len(blocks), 256):
        w = _windows(net, blocks[i:i + 256])
        y = np.ascontiguousarray(w).reshape(-1, WIDTH * VECTOR) @ net["filters"]
        out[i:i + 256] = y.reshape(len(w), -1, FILTERS).max(axis=1)
    return out + net["filter_bias"]


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    """One probability for each text. Long ones are read in pieces of
    blocks, so memory holds a few megabytes, however long a text is."""
    pieces = [blocks_of(t) for t in texts]
    size = np.array([len(p) for p in pieces])
    best = np.concatenate([_responses(net, p) for p in _merged(pieces)])
    pooled, text, _, _ = _chunks(best, np.cumsum(size) - size, size)
    z = np.maximum(0, pooled @ net["layer"] + net["layer_bias"])
    mean, most = _pool(z, text, len(size))
    out = np.concatenate([mean, most], axis=1) @ net["out"] + net["out_bias"]
    return (1 / (1 + np.exp(-out[:, 0].astype(float)))).clip(0.0, 1.0)


def _merged(pieces: list[np.ndarray]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for p in pieces:
        held.append(p)
        n += len(p)
        if n >= 1024:
            yield np.concatenate(held) if len(held) > 1 else held[0]
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _gradients(net: Net, texts: list[np.ndarray], y: np.ndarray) -> Net:
    size = np.array([len(t) for t in texts])
    blocks = np.concatenate(texts)
    w = _windows(net, blocks)
    r = np.ascontiguousarray(w).reshape(-1, WIDTH * VECTOR) @ net["filters"]
    r = r.reshape(len(blocks), -1, FILTERS)
    which = r.argmax(axis=1)
    best = np.take_along_axis(r, which[:, None], axis=1)[:, 0] + net["filter_bias"]
    pooled, text, a, b = _chunks(best, np.cumsum(size) - size, size)
    pre = pooled @ net["layer"] + net["layer_bias"]
    z = np.maximum(0, pre)
    mean, most = _pool(z, text, len(size))
    both = np.concatenate([mean, most], axis=1)
    p = 1 / (1 + np.exp(-(both @ net["out"] + net["out_bias"])[:, 0]))
    d_out = ((p - y) / len(y))[:, None].astype(np.float32)
    d_both = d_out @ net["out"].T
    many = np.bincount(text)[text][:, None]
    d_z = d_both[text, :HIDDEN] / many + d_both[text, HIDDEN:] * (z == most[text])
    d_pre = d_z * (pre > 0)
    d_pooled = d_pre @ net["layer"].T
    d_best = np.zeros_like(best)
    from_a = best[a] >= best[b]
    np.add.at(d_best, a, d_pooled * from_a)
    np.add.at(d_best, b, d_pooled * ~from_a)
    row = np.arange(len(blocks))[:, None]
    seen = w[row, which]  # (block, filter, WIDTH * VECTOR)
    d_filters = np.einsum("bfk,bf->kf", seen, d_best)
    d_seen = d_best[:, :, None] * net["filters"].T[None]
    at = blocks[row[:, :, None], which[:, :, None] * STEP + np.arange(WIDTH)]
    d_bytes = np.zeros_like(net["bytes"])
    np.add.at(d_bytes, at.ravel(), d_seen.reshape(-1, VECTOR))
    return {"bytes": d_bytes, "filters": d_filters, "filter_bias": d_best.sum(0), "layer": pooled.T @ d_pre,
            "layer_bias": d_pre.sum(0), "out": both.T @ d_out, "out_bias": d_out.sum(0)}


def fit(texts: list[bytes], y: np.ndarray, passes: int = PASSES) -> Net:
    """Adam on the logistic loss, both labels weighing the same in every
    step. A step shows a passage of each of its texts, which may lie anywhere
    in it, so no part of a long text is left out. The seed is fixed, so the
    same rows give the same network."""
    rng = np.random.default_rng(7)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    net = {"bytes": draw(256, VECTOR, scale=0.5), "filters": draw(WIDTH * VECTOR, FILTERS, scale=0.15),
           "filter_bias": np.zeros(FILTERS, np.float32), "layer": draw(FILTERS, HIDDEN, scale=0.15),
           "layer_bias": np.zeros(HIDDEN, np.float32), "out": draw(2 * HIDDEN, 1, scale=0.2),
           "out_bias": np.zeros(1, np.float32)}

    def shown(i: int) -> np.ndarray:
        t = texts[i]
        n = int(rng.integers(8, 160)) if y[i] and rng.random() < SHORTENED else SHOWN_BYTES
        a = int(rng.integers(0, max(1, len(t) - n + 1)))
        return blocks_of(t[a:a + n])
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    steps = passes * max(1, len(y) // STEP_ROWS)
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(s, STEP_ROWS // 2) for s in sides])
        grads = _gradients(net, [shown(i) for i in rows], y[rows])
        rate = RATE * min(1.0, 3 * (1 - (step - 1) / steps))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net[k] = (net[k] - rate * (first[k] / (1 - 0.9 ** step))
                      / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame) -> Net | None:
    """Fits on the whole texts of at most SAMPLE_ROWS rows of each label that
    are not held out, chosen by the hash of their id. None if there are not
    two classes."""
    given = labels.filter("quality in (0, 1) and doc_id is not null").filter(
        id_remainder(F.col("doc_id"), HELD_OUT) != 2).select("doc_id", "quality")
    some = least_rows(given, "quality", F.xxhash64("doc_id"), SAMPLE_ROWS).dropDuplicates(["doc_id"])
    rows = (docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id")
            .dropDuplicates(["doc_id"]).select("doc_id", "quality", "text"))
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])  # bounded: two labels x rows
    y = np.array([r["quality"] for r in got], np.float32)
    if len(set(y)) < 2:
        return None
    return fit([r["text"].encode("utf-8", "replace") for r in got], y)


def classify(docs: DataFrame, net: Net | None, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of label 1 (it replaces a column of
    that name). Null and empty texts are scored as one block of nothing;
    without a net every score is 0.5. Repeated rows are each scored, an empty
    table gives an empty one, a very long text is scored whole, in blocks.
    Rows are read one batch at a time."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            b = [(t or "").encode("utf-8", "replace") for t in texts]
            parts = [probabilities(net, b[i:i + 64]) for i in range(0, len(b), 64)] if net else [np.full(len(b), 0.5)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
    return docs.withColumn(out, scored(F.col(text)))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held out or not, score, and 1 if it reaches THRESHOLD."""
    found = classify(docs.select("doc_id", "text"), train(docs, labels), out="score")
    return found.select("doc_id", (id_remainder(F.col("doc_id"), HELD_OUT) == 2).alias("held_out"), "score",
                        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
