"""Whitening of embeddings by their leading principal components.

Entries are made integers (``floor(256 c)``), so sums and squared distances
are exact whatever the order of the rows. Each distinct vector counts once:
it is packed in the fewest bytes that hold it and duplicates meet by value,
pre-aggregated by every task.

1. Sums of each dimension, exact, from the distinct vectors.
2. Every task adds up products of centred vectors in one matrix, and emits
   its rows; rows of all tasks are summed where they meet.
3. A matrix is made tridiagonal by Householder reflections. Its leading
   eigenvalues come from bisection on Sturm counts, their vectors from
   inverse iteration, made orthogonal within clusters of close eigenvalues
   and carried back through the reflections.
4. The components, a few vectors, are broadcast; every row is projected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carledger.llm.common import batches, only_caches_of, ship, sized_parts, stage

SCALE, COMPONENTS = 256, 4
#: Eigenvalues below this part of the trace cannot be told from rounding.
LEAST_SHARE = 1e-11
#: Eigenvalues closer than this part of the matrix's norm are one cluster.
CLUSTER = 1e-3
#: Bits of a limb of the sums, and the largest entry for which products of
#: limbs and entries add up within 64 bits.
LIMB, SMALL = 28, 1 << 20
ROWS = 4096


# ------------------------------------------------------- symmetric eigenpairs

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix."""
    a = a.copy()
    n, steps = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        norm = np.sqrt((x * x).sum())
        if norm == 0:
            continue
        to = -np.copysign(norm, x[0])
        x[0] -= to
        v = x / np.sqrt((x * x).sum())
        steps.append((k + 1, v))
        below = a[k + 1:, k + 1:]
        p = below @ v
        w = 2 * (p - (v @ p) * v)
        below -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = to
    return np.diag(a).copy(), np.diag(a, -1).copy(), steps


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of the points ``at``."""
    tiny = np.finfo(float).tiny * max(1.0, float((e * e).max(initial=0)) * 4)
    q = d[0] - at
    below = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - at - e[i - 1] * e[i - 1] / q
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bit."""
    n = len(d)
    reach = np.zeros(n)
    reach[:-1] += np.abs(e)
    reach[1:] += np.abs(e)
    pad = 4 * np.finfo(float).eps * max(np.abs(d).max(), reach.max(), np.finfo(float).tiny)
    lo, hi = np.full(k, (d - reach).min() - pad), np.full(k, (d + reach).max() + pad)
    place = n - np.arange(k)
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi) | (hi - lo < 1e-20)).all():
            return hi
        under = sturm_counts(d, e, mid) >= place
        lo, hi = np.where(under, lo, np.maximum(mid, lo)), np.where(under, mid, hi)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; zero pivots
    are replaced by ``least``."""
    n = len(d)
    a, up, up2, low, b = d - shift, np.append(e, 0.0), np.zeros(n), e.copy(), b.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(a[i]):
            a[i], low[i] = low[i], a[i]
            up[i], a[i + 1] = a[i + 1], up[i]
            if i + 1 < n - 1:
                up2[i], up[i + 1] = up[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(a[i]) < least:
            a[i] = np.copysign(least, a[i])
        f = low[i] / a[i]
        a[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
        b[i + 1] -= f * b[i]
    if abs(a[-1]) < least:
        a[-1] = np.copysign(least, a[-1])
    x = np.zeros(n)
    for i in reversed(range(n)):
        x[i] = (b[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (up2[i] * x[i + 2] if i + 2 < n else 0)) / a[i]
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix. Vectors of one
    cluster are made orthogonal to each other after every step."""
    norm = float((np.abs(d) + np.append(np.abs(e), 0) + np.append(0, np.abs(e))).max()) or 1.0
    rng, out, cluster = np.random.default_rng(0), np.zeros((len(values), len(d))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            cluster = k
        x = rng.standard_normal(len(d))
        # Equal eigenvalues are solved at points a few roundings apart.
        shift = value - (k - cluster) * 4 * np.finfo(float).eps * norm
        for _ in range(6):
            for _ in range(2):
                for y in out[cluster:k]:
                    x -= (x @ y) * y
            x /= np.sqrt(x @ x)
            x = _solve(d, e, shift, x, np.finfo(float).eps * norm)
            x /= np.abs(x).max()
        for _ in range(2):
            for y in out[cluster:k]:
                x -= (x @ y) * y
            x /= np.sqrt(x @ x)
        out[k] = x
    return out


def leading_pairs(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors in rows) of a covariance, at
    most ``k`` and only those that rise above rounding."""
    trace = float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((0, len(v)))
    size = float(np.abs(v).max())
    d, e, steps = tridiagonal(v / size)
    values = leading_values(d, e, min(k, len(v)))
    values = values[values * size > LEAST_SHARE * trace]
    vectors = leading_vectors(d, e, values)
    for at, h in reversed(steps):
        part = vectors[:, at:]
        part -= 2 * np.outer(part @ h, h)
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return values * size, vectors


# ------------------------------------------------------------ whole vectors

def integers(c: np.ndarray) -> np.ndarray:
    """floor(256 c); what exceeds 64 bits is held at their ends."""
    x = np.floor(c.astype(float) * SCALE)
    low, high = -2.0 ** 63, 2.0 ** 63
    out = np.where((x >= low) & (x < high), x, 0).astype(np.int64)
    out[x >= high] = np.iinfo(np.int64).max
    out[x < low] = np.iinfo(np.int64).min
    return out


def by_length(b: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integer vectors) for each vector length of a batch."""
    a = b.column(column)
    flat = np.asarray(a.flatten(), float)
    n = np.asarray(a.value_lengths(), np.int64)
    start = np.cumsum(n) - n
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield rows, integers(flat[start[rows][:, None] + np.arange(d)])


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
            .filter(F.col("embedding").isNotNull() & fine))


FIT = "dim int, x binary"


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """A written table of the distinct integer vectors: (dim, x), x in the
    least of 2, 4 and 8 bytes an entry that holds the vector."""
    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("whitening")
        for b in batches(it, ROWS):
            for _, x in by_length(b, "embedding"):
                if not x.shape[1]:
                    continue
                high, low, out = x.max(axis=1), x.min(axis=1), np.full(len(x), None, object)
                todo = np.ones(len(x), bool)
                for kind in ("<i2", "<i4", "<i8"):
                    lim = np.iinfo(kind)
                    now = todo & (high <= lim.max) & (low >= lim.min)
                    out[now] = [y.tobytes() for y in x[now].astype(kind)]
                    todo &= ~now
                yield pa.record_batch([pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(list(out), pa.binary())], names=["dim", "x"])
    return stage(rows.select("embedding").mapInArrow(packed, FIT).dropDuplicates(["dim", "x"]), "distinct-vectors")


def unpacked(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Integer matrices, one for each length and width in a batch."""
    dim, x = np.asarray(b.column("dim")), b.column("x").to_pylist()
    width = np.array([len(y) for y in x]) // np.maximum(dim, 1)
    for d, w in sorted(set(zip(dim.tolist(), width.tolist()))):
        own = np.flatnonzero((dim == d) & (width == w))
        yield np.frombuffer(b"".join(x[i] for i in own), f"<i{w}").reshape(-1, d).astype(np.int64)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (n, S)}, exact. Sums of a length are as long as its vectors."""
    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches(it, ROWS):
            for x in unpacked(b):
                t = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                t[0] += len(x)
                # Halves of 32 bits add up within 64.
                t[1] += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        rows = [(d, i, n, str(s)) for d, (n, v) in total.items() for i, s in enumerate(v)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                               pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())], names=["dim", "i", "n", "s"])
    found = (fit.mapInArrow(added, "dim int, i int, n long, s string").groupBy("dim", "i")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found:
        out.setdefault(r["dim"], (r["n"], [0] * r["dim"]))[1][r["i"]] = int(r["s"])
    return out


def components(fit: DataFrame, moments: dict, k: int) -> dict:
    """{length: (eigenvalues, trace, components in rows)}. A matrix is as
    large as its vectors are long, squared, and is solved in one task."""
    spark = fit.sparkSession
    mean = spark.sparkContext.broadcast({d: np.array([s / n for s in t]) for d, (n, t) in moments.items()})
    number = {d: n for d, (n, _) in moments.items()}

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches(it, ROWS):
            for x in unpacked(b):
                c = x - mean.value[x.shape[1]]
                total[x.shape[1]] = total.get(x.shape[1], 0) + c.T @ c
        part = TaskContext.get().partitionId()
        for d, m in total.items():
            yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([part] * d, pa.int32()),
                                   pa.array([r.tobytes() for r in m], pa.binary())], names=["dim", "i", "part", "r"])

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, None

        def done():
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([row.tobytes()], pa.binary())],
                                   names=["dim", "i", "r"])
        for b in it:
            for d, i, r in zip(*(b.column(c).to_pylist() for c in ("dim", "i", "r"))):
                if (d, i) != key:
                    if key is not None:
                        yield done()
                    key, row = (d, i), np.zeros(d)
                row = row + np.frombuffer(r)
        if key is not None:
            yield done()

    def solved(t: pd.DataFrame) -> pd.DataFrame:
        d, t = int(t["dim"].iloc[0]), t.sort_values("i")
        v = np.stack([np.frombuffer(r) for r in t["r"]]) / number[d]
        v = (v + v.T) / 2
        values, vectors = leading_pairs(v, k)
        return pd.DataFrame({"dim": d, "component": np.arange(1, len(values) + 1), "e": values, "trace": np.trace(v),
                             "axis": [x.tobytes() for x in vectors]})
    rows = fit.mapInArrow(products, "dim int, i int, part int, r binary").repartition(sized_parts(fit), "dim", "i")
    rows = rows.sortWithinPartitions("dim", "i", "part").mapInArrow(added, "dim int, i int, r binary")
    found = rows.groupBy("dim").applyInPandas(solved, "dim int, component int, e double, trace double, axis binary")
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r["dim"], r["component"])):
        own = out.setdefault(r["dim"], ([], r["trace"], []))
        own[0].append(r["e"])
        own[2].append(np.frombuffer(r["axis"]))
    return {d: (np.array(e), trace, np.stack(axes)) for d, (e, trace, axes) in out.items()}


def project(x: np.ndarray, n: int, total: list[int], values: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - np.array([s / n for s in total])) @ axes.T / np.sqrt(values)


def identity_errors(fit: DataFrame, model) -> dict[int, float]:
    """{length: largest absolute entry of the whitened vectors' covariance
    less the identity}, over the distinct vectors; Spark's own covariance is
    centred before it multiplies."""
    k = max((len(m[2]) for m in model.value.values()), default=0)
    if not k:
        return {}

    def whitened(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, ROWS):
            for x in unpacked(b):
                d = x.shape[1]
                if d in model.value:
                    w = project(x, *model.value[d][:2], *model.value[d][2:4])
                    yield pa.record_batch([pa.array([d] * len(w), pa.int32()), pa.array(list(w), pa.list_(pa.float64()))], names=["dim", "w"])
    rows = fit.mapInArrow(whitened, "dim int, w array<double>")
    w = [F.get("w", F.lit(i)) for i in range(k)]
    off = [F.abs(F.covar_pop(w[i], w[j]) - (1.0 if i == j else 0.0)) for i in range(k) for j in range(i + 1)]
    worst = F.greatest(*off) if len(off) > 1 else off[0]
    return {r["dim"]: r["worst"] for r in rows.groupBy("dim").agg(worst.alias("worst")).collect()}


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2 for each row, exact: entries and
    limbs of S are multiplied in 64 bits, the few results joined exactly."""
    if len(x) and max(int(x.max()), -int(x.min())) >= SMALL:
        d = x.astype(object) * n - np.array(total, object)
        return (d * d).sum(axis=1).tolist()
    squares = (x * x).sum(axis=1).tolist()
    cross, left, shift = [0] * len(x), list(total), 0
    while any(left):
        last = all(s in (0, -1) for s in left)
        limb = left if last else [s & ((1 << LIMB) - 1) for s in left]
        cross = [c + (p << shift) for c, p in zip(cross, (x @ np.array(limb, np.int64)).tolist())]
        left = [] if last else [s >> LIMB for s in left]
        shift += LIMB
    own = sum(s * s for s in total)
    return [n * n * q - 2 * n * c + own for q, c in zip(squares, cross)]


OUT = "vec_id long, n long, deviation long, deviation_digits string, whitened array<double>, explained array<double>, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """For each usable row of ``vectors`` (vec_id, embedding; others are
    ignored) and component: vec_id, component, n, deviation, whitened,
    explained, identity_error, deviation_digits.

    Rows whose vector is null or holds null or non-finite entries are left
    out. Vectors of different lengths are fitted apart, however many lengths
    there are: n, components and errors are those of a row's own length; the
    driver holds the means and components of each. A component exists only
    where the vectors vary: n equal or too few vectors have fewer than ``k``,
    and rows of a length without any (or of length 0) give no rows. Tied
    eigenvalues get any orthogonal components of their space. Repeated rows
    count once in the fit and are repeated in the result; an empty table
    gives an empty one. ``deviation`` is null beyond 64 bits, which it
    reaches at some 10^8 vectors; ``deviation_digits`` always has it whole.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    fit = distinct_vectors(rows)
    moments = sums(fit)
    found = components(fit, moments, k)
    model = spark.sparkContext.broadcast({d: (*moments[d], *found[d][::2], found[d][1]) for d in found})
    errors = identity_errors(fit, model)

    def projected(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, ROWS):
            for own, x in by_length(b, "embedding"):
                d = x.shape[1]
                if d not in model.value:
                    continue
                n, total, values, axes, trace = model.value[d]
                far, m = deviations(x, n, total), len(x)
                w = project(x, n, total, values, axes)
                yield pa.record_batch([
                    b.column("vec_id").take(pa.array(own)), pa.array([n] * m, pa.int64()),
                    pa.array([v if v < 2 ** 63 else None for v in far], pa.int64()), pa.array(list(map(str, far)), pa.string()),
                    pa.array(list(w), pa.list_(pa.float64())), pa.array([(values / trace).tolist()] * m, pa.list_(pa.float64())),
                    pa.array([errors.get(d)] * m, pa.float64())], names=[c.split()[0] for c in OUT.split(", ")])
    each = rows.mapInArrow(projected, OUT).select(
        "vec_id", "n", "deviation", "deviation_digits", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                       F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error", "deviation_digits")
