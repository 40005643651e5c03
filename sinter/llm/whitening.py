"""Whitening of embeddings.

Entries are quantised to whole numbers, x = floor(64 c) + 1000000, and the
covariance is taken over the fit list: every distinct x vector once. It is
found in two passes over the fit list: exact sums of every dimension, then
products of rows that are centred on the exact mean (n x - S, whole numbers,
over n) before they are multiplied. Tasks hand on one small matrix each,
which two rounds of grouped sums add up; only the d x d matrix reaches the
driver.

There Householder reflections bring the matrix to tridiagonal form, Sturm
counts bisect the leading eigenvalues, and inverse iteration finds their
vectors, each orthogonalised against those of its cluster (eigenvalues that
lie close together) after every step; the reflections turn them back. The
components go out by broadcast and every row is projected where it lies. A
last pass over the fit list measures how far the whitened covariance is from
the identity.

Defined results: rows whose vector is null, empty or holds null or
non-finite entries are dropped, and so are rows whose vector has not the
table's most frequent length (the longer one of equally frequent lengths);
entries beyond +-2^62 / 64 count as that bound; repeated rows and ids are
all projected, and a null id stays null; components whose eigenvalue is zero
to rounding (``RANK`` of the largest) don't exist, so vectors that are all
alike, and empty tables, give no rows; ``deviation`` is null where it
exceeds 64 bits; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinter.llm.common import map_arrow, ship, store

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
RANK = 1e-12
CLUSTER = 1e-3   # of the matrix norm: closer eigenvalues are one cluster
STEPS = 5        # of inverse iteration
FAN = 256        # partial sums that one group adds up


# ------------------------------------------------------------ eigenvectors
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix, by
    Householder reflections I - 2 v v' from the first column on."""
    a = a.copy()
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        length = np.sqrt(x @ x)
        rest = np.abs(x[1:]).max()
        if length == 0.0 or rest == 0.0:
            reflectors.append(np.zeros(len(x)))
            continue
        v = x
        turned = -np.copysign(length, x[0])
        v[0] -= turned
        v /= np.sqrt(v @ v)
        reflectors.append(v)
        block = a[k + 1:, k + 1:]
        p = 2.0 * (block @ v)
        w = p - (p @ v) * v
        block -= np.outer(v, w)
        block -= np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = turned
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def count_below(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: eigenvalues of the tridiagonal matrix below each x."""
    square = off * off
    tiny = np.finfo(float).tiny * max(1.0, square.max(initial=0.0))
    q, below = diag[0] - x, np.zeros(len(x), np.int64)
    for i in range(len(diag)):
        if i:
            q = diag[i] - x - square[i - 1] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts."""
    n = len(diag)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low = np.full(k, (diag - reach).min())
    high = np.full(k, (diag + reach).max())
    pad = 2 * n * np.finfo(float).eps * max(np.abs(low[0]), np.abs(high[0])) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    want = n - np.arange(k)  # eigenvalues up to the j-th largest
    while True:
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        under = count_below(diag, off, mid) >= want
        high = np.where(under, mid, high)
        low = np.where(under, low, mid)


def _factor(diag, off, x: float, small: float):
    """LU factors, with row swaps, of the tridiagonal matrix minus x."""
    n = len(diag)
    u0, u1, u2 = [d - x for d in diag], [*off, 0.0], [0.0] * n
    lower, swap = [0.0] * n, [False] * n
    for i in range(n - 1):
        below = off[i]
        if abs(below) > abs(u0[i]):
            swap[i] = True
            lower[i] = u0[i] / below
            # row i + 1 becomes the pivot row
            u0[i], keep = below, u1[i]
            u1[i], u2[i] = u0[i + 1], u1[i + 1]
            u0[i + 1], u1[i + 1] = keep - lower[i] * u1[i], -lower[i] * u2[i]
        else:
            if abs(u0[i]) < small:
                u0[i] = small
            lower[i] = below / u0[i]
            u0[i + 1] -= lower[i] * u1[i]
    if abs(u0[-1]) < small:
        u0[-1] = small
    return u0, u1, u2, lower, swap


def _solve(lu, b: np.ndarray) -> np.ndarray:
    u0, u1, u2, lower, swap = lu
    y, n = b.tolist(), len(b)
    for i in range(n - 1):
        if swap[i]:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= lower[i] * y[i]
    for i in range(n - 1, -1, -1):
        t = y[i]
        if i + 1 < n:
            t -= u1[i] * y[i + 1]
        if i + 2 < n:
            t -= u2[i] * y[i + 2]
        y[i] = t / u0[i]
    y = np.array(y)
    return y / np.abs(y).max()


def vectors_of(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse
    iteration; a vector is orthogonalised against the others of its cluster
    after every step."""
    n = len(diag)
    norm = max(np.abs(diag).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(float).tiny)
    eps = np.finfo(float).eps
    rng = np.random.default_rng(11)
    out = np.zeros((n, len(values)))
    d, e = diag.tolist(), off.tolist()
    first, used = 0, 0.0
    for j, x in enumerate(values.tolist()):
        if j and values[j - 1] - x > CLUSTER * norm:
            first = j
        # shifts of one cluster differ, so equal ones don't repeat a factor
        x = min(x, used - 10 * eps * norm) if j > first else x
        used = x
        lu = _factor(d, e, x, eps * norm)
        v = rng.standard_normal(n)
        for _ in range(STEPS):
            v = _solve(lu, v)
            for _ in range(2):
                v -= out[:, first:j] @ (out[:, first:j].T @ v)
            v /= np.sqrt(v @ v)
        out[:, j] = v
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors (columns)."""
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(k), np.eye(len(a))[:, :k]
    a = a / scale
    diag, off, reflectors = tridiagonal(a)
    v = vectors_of(diag, off, leading_values(diag, off, k))
    for i in range(len(reflectors) - 1, -1, -1):
        r, rows = reflectors[i], v[i + 1:]
        rows -= 2.0 * np.outer(r, r @ rows)
    v /= np.sqrt((v * v).sum(0))
    value = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-value, kind="stable")
    return value[order] * scale, v[:, order]


# ------------------------------------------------------------ covariance
def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part; x as long."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    most = float(1 << 62)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-most), F.least(
        F.lit(most), F.lit(SCALE) * c.cast("double")))) + F.lit(SHIFT))
    return (vectors.select(F.col(id_col).alias("id"), F.col(vec_col))
            .filter(v.isNotNull() & (F.size(v) > 0) & ~bad).select("id", x.alias("x")))


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit where that holds it, else Python numbers."""
    most = max(int(x.max()), -int(x.min()), 1) * n
    if most < 1 << 61 and max(abs(s) for s in sums) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(num: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond 64 bits."""
    most = max(int(num.max()), -int(num.min()))
    if num.dtype != object and most * most * num.shape[1] < 1 << 63:
        return (num * num).sum(1).tolist()
    total = (num.astype(object) ** 2).sum(1)
    return [t if t < 1 << 63 else None for t in total]


def _rows(batches, column: int):
    """x matrices of Arrow batches."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def sums_of(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension) of the fit list."""
    def add(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for _, x in _rows(batches, 0):
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)],
            names=["i", "n", "high", "low"])

    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    got = map_arrow(fit.select("x"), add, "i int, n long, high long, low long").groupBy("i").agg(*whole).collect()
    if not got:
        return 0, []
    sums = [0] * dim
    for r in got:
        sums[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return int(got[0]["n"]), sums


def covariance(fit: DataFrame, n: int, centre) -> np.ndarray:
    """Covariance, divisor n, of ``centre(x)`` over the fit list, whose rows
    ``centre`` has brought to mean zero but for rounding. A task emits its
    sums row by row of the matrix; groups of ``FAN`` tasks add up, then these."""
    def products(batches):
        total = None
        for _, x in _rows(batches, 0):
            y = centre(x)
            part = np.vstack([y.T @ y, y.sum(0)])
            total = part if total is None else total + part
        if total is not None:
            k = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k), pa.int32()), pa.array(np.full(k, TaskContext.get().partitionId() // FAN), pa.int32()),
                 pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "part", "v"])

    def add(group):
        v = np.array(group["v"].combine_chunks().flatten()).reshape(group.num_rows, -1).sum(0)
        return pa.table({"i": group["i"][:1].cast(pa.int32()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "i int, v array<double>"
    ship(fit.sparkSession)
    parts = map_arrow(fit.select("x"), products, "i int, part int, v array<double>")
    got = parts.groupBy("i", "part").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema).collect()
    m = np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])
    mean = m[-1] / n
    return m[:-1] / n - np.outer(mean, mean)


# ------------------------------------------------------------ the operator
@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray   # columns: unit components
    values: np.ndarray    # their eigenvalues, falling
    trace: float

    def whiten(self, num: np.ndarray) -> np.ndarray:
        y = np.asarray(num / self.n, np.float64)
        return y @ self.vectors / np.sqrt(self.values)


def fit_components(fit: DataFrame, dim: int, k: int = COMPONENTS) -> Whitening | None:
    """Mean and leading components of a written fit list of x vectors of
    ``dim`` entries; None if there is no component."""
    n, sums = sums_of(fit, dim)
    if not n:
        return None
    cov = covariance(fit, n, lambda x: np.asarray(numerators(x, n, sums) / n, np.float64))
    cov = (cov + cov.T) / 2
    values, vectors = eigen(cov, min(k, dim))
    real = values > RANK * max(values[0], 0.0)
    if not real.any():
        return None
    return Whitening(n, sums, vectors[:, real], values[real], float(np.trace(cov)))


def whitened(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` and component: id, component
    (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    schema = T.StructType([
        T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("n", "deviation")),
        *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    rows = quantised(vectors, id_col, vec_col)
    length = (rows.groupBy(F.size("x").alias("dim")).count()
              .orderBy(F.desc("count"), F.desc("dim")).limit(1).collect())
    if not length:
        return spark.createDataFrame([], schema)
    dim = length[0]["dim"]
    rows = rows.filter(F.size("x") == dim)
    fit = store(rows.select("x").distinct(), "whitening-fit")
    model = fit_components(fit, dim, k)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def centre(x):
        m = shared.value
        return m.whiten(numerators(x, m.n, m.sums))

    c = len(model.values)
    error = float(np.abs(covariance(fit, model.n, centre) - np.eye(c)).max())

    def project(batches):
        m = shared.value
        for batch, x in _rows(batches, 1):
            num = numerators(x, m.n, m.sums)
            each = np.repeat(np.arange(len(x)), c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)),
                 pa.array(np.tile(np.arange(1, c + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(each), m.n)),
                 pa.array(squares(num), pa.int64()).take(pa.array(each)),
                 pa.array(m.whiten(num).ravel()),
                 pa.array(np.tile(m.values / m.trace, len(x))),
                 pa.array(np.full(len(each), error))], names=schema.names)

    return map_arrow(rows, project, schema)
