"""Whitening of embeddings by their leading principal components.

The covariance is distributed: exact integer sums of all rows first, then, in a second pass, products of centred rows,
summed within a task and by Spark over tasks. A covariance is as large as the square of a vector's length, whatever the
number of rows. The driver makes it tridiagonal by Householder reflections, finds its leading eigenvalues by bisection
on Sturm counts and their vectors by inverse iteration, with those of a cluster made orthogonal to each other, and
reflects them back. Rows are then projected side by side; what is broadcast is as long as components times dimensions.

Defined results
  Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those with an entry beyond
  2**56 in size, which have no place on the grid of 64-bit integers. Vectors of each length are a list of their own.
  Components without variance (a list of one row, equal rows, fewer rows than dimensions) can't be whitened: only those
  with an eigenvalue above rounding errors are returned, so such lists have fewer rows, or none. Repeated rows and ids: a row each.
  Equal eigenvalues: any orthonormal basis of their space. Deviations beyond 64 bits are null. Empty table: no rows.
  Extra columns are ignored. Longest vectors: ``DIMENSIONS`` entries, else ValueError, as the driver holds their covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the grid in a unit, and its origin: fixed values of the contract.
STEPS, ORIGIN = 64, 1_000_000
#: Entries of a vector at most; rows of a block of products.
DIMENSIONS, BLOCK = 4096, 8192
_LOW = 24


# ---------------------------------------------------------------- symmetric eigenproblem

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): H a H with the product H of the reflectors, each a unit vector or zero."""
    a = np.array(a, float)
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        if np.abs(x[1:]).max() < 1e-100:  # already so; smaller squares would vanish
            a[k + 2 :, k] = a[k, k + 2 :] = 0
            reflectors.append(np.zeros(n - k - 1))
            continue
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        x -= 2 * (v @ x) * v
        a[k, k + 1 :] = a[k + 1 :, k]
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def reflected(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Columns of the tridiagonal problem as columns of the first one."""
    out = vectors.copy()
    for k in reversed(range(len(reflectors))):
        v, part = reflectors[k], out[k + 1 :]
        part -= 2 * np.outer(v, v @ part)
    return out


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each value."""
    tiny = np.finfo(float).eps * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until an interval can't be halved."""
    n, around = len(d), np.concatenate([[0], np.abs(e)]) + np.concatenate([np.abs(e), [0]])
    low, high = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    wanted = n - 1 - np.arange(k)  # the j-th largest has so many below it
    while True:
        middle = 0.5 * (low + high)
        if not ((middle > low) & (middle < high)).any():
            return middle
        above = below(d, e, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; pivots of nought are taken for the least that counts."""
    n = len(d)
    tiny = np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max(initial=0), np.finfo(float).tiny)
    u, v, w, y = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        if abs(u[i]) >= abs(e[i]):
            f = e[i] / u[i] if u[i] else 0.0
            u[i + 1] -= f * v[i]
            y[i + 1] -= f * y[i]
        else:
            f = u[i] / e[i]
            u[i], v[i], u[i + 1], above = e[i], u[i + 1], v[i], v[i + 1]
            w[i], v[i + 1] = above, -f * above
            u[i + 1] -= f * v[i]
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
    x = np.zeros(n + 2)
    for i in reversed(range(n)):
        pivot = u[i] if abs(u[i]) > tiny else np.copysign(tiny, u[i])
        x[i] = (y[i] - v[i] * x[i + 1] - w[i] * x[i + 2]) / pivot
        if abs(x[i]) > 1e200:  # only the direction counts
            y /= 1e200
            x /= 1e200
    return x[:n]


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit columns by inverse iteration; each is kept orthogonal to the earlier ones of its cluster."""
    n, norm = len(d), max(np.abs(d).max(), np.abs(e).max(initial=0))
    out, first, rng = np.zeros((n, len(values))), 0, np.random.default_rng(1)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        x = rng.standard_normal(n)
        for _ in range(rounds):
            x = _solved(d, e, value, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(3):  # again, as little may be left of it
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
                x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the k leading eigenpairs of a symmetric matrix."""
    scale = np.abs(a).max(initial=0)
    if not scale or not k:
        return np.zeros(k), np.eye(len(a))[:, :k]
    d, e, reflectors = tridiagonal(a / scale)
    e = np.where(np.abs(e) > np.finfo(float).eps ** 2, e, 0.0)
    values = leading_values(d, e, k)
    vectors = reflected(leading_vectors(d, e, values), reflectors)
    return values * scale, vectors


# ---------------------------------------------------------------- distributed sums

def usable(vector: Column) -> Column:
    """Whether a vector is on the grid."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= float(1 << 56)), F.lit(False))), F.lit(False))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, slice | np.ndarray, np.ndarray]]:
    """(length, rows, grid values) of the rows of each length, ``BLOCK`` rows at most."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(offsets)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for k in range(0, len(rows), BLOCK):
            own = rows[k : k + BLOCK]
            yield d, own, np.floor(STEPS * flat[offsets[own][:, None] + np.arange(d)]).astype(np.int64) + ORIGIN


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums a batch, of high and low bits apart, so that no sum leaves 64 bits."""
    for batch in batches:
        for d, own, x in _blocks(batch, 0):
            yield pa.RecordBatch.from_pydict({"d": [d], "n": [len(own)], "high": [(x >> _LOW).sum(0)], "low": [(x & (1 << _LOW) - 1).sum(0)]}, pa.schema([("d", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))


@dataclass
class Fit:
    """What is known of the vectors of one length: rows, exact sums, and in time components."""

    n: int
    sums: list[int]
    values: np.ndarray | None = None
    axes: np.ndarray | None = None
    trace: float = 0.0

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], object)
        self.part = np.array([r / self.n for r in self.rest.tolist()])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: whole numbers first, so that nothing large is rounded."""
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) ** 2, exact; None beyond 64 bits."""
        away = x - self.whole
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * away - self.rest.astype(np.int64)) ** 2).sum(1).tolist()
        found = ((self.n * away.astype(object) - self.rest) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in found]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)


def _products(rows: DataFrame, fits: dict[int, Fit], of) -> dict[int, np.ndarray]:
    """By length, the mean over all rows of the outer products of ``of(fit, x)`` with themselves."""
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _blocks(batch, 0):
                if d in sent.value:
                    y = of(sent.value[d], x)
                    held[d] = held.get(d, 0) + y.T @ y
        for d, m in held.items():
            for i, row in enumerate(m):
                yield pa.RecordBatch.from_pydict({"d": [d] * len(row), "i": [i] * len(row), "j": range(len(row)), "v": row}, pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    found = rows.mapInArrow(run, "d int, i int, j int, v double").where("i <= j").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # a row for each pair of dimensions
    out = {}
    for d, part in found.groupby("d"):
        size = int(part["j"].max()) + 1
        m = np.zeros((size, size))
        m[part["i"], part["j"]] = m[part["j"], part["i"]] = part["v"]
        out[int(d)] = m / fits[int(d)].n
    return out


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 32) -> dict[int, Fit]:
    """By length of vectors: rows, sums, leading eigenvalues with their unit vectors, and the covariance's trace."""
    rows = vectors.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    by_task = rows.mapInArrow(_sums, "d int, n long, high array<long>, low array<long>")
    wide = by_task.select("d", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    whole = "decimal(38,0)"
    found = wide.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s.high").cast(whole)).alias("high"), F.sum(F.col("s.low").cast(whole)).alias("low")).orderBy("d", "i").collect()  # a row for each dimension
    fits: dict[int, Fit] = {}
    for d in sorted({r["d"] for r in found}):
        if d > DIMENSIONS:
            raise ValueError(f"vectors have at most {DIMENSIONS} entries")
        own = [r for r in found if r["d"] == d]
        fits[d] = Fit(own[0]["n"], [(int(r["high"]) << _LOW) + int(r["low"]) for r in own])
    for d, v in _products(rows, fits, Fit.centred).items():
        f, k = fits[d], min(components, d)
        values, axes = leading(v, k)
        kept = values > np.finfo(float).eps * d * max(values[0], 0.0)
        f.values, f.axes, f.trace = values[kept], axes[:, kept], float(np.trace(v))
    return {d: f for d, f in fits.items() if f.values is not None and len(f.values)}


def identity_errors(vectors: DataFrame, fits: dict[int, Fit], vector: str = "embedding") -> dict[int, float]:
    """By length, the largest absolute entry of the covariance of all whitened rows minus the identity."""
    rows = vectors.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    return {d: float(np.abs(m - np.eye(len(m))).max()) for d, m in _products(rows, fits, Fit.whitened).items()}


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(id, n, deviation, whitened array<double>, explained array<double>, identity_error) of every row on the grid."""
    fits = fit(vectors, vector, components)
    errors = identity_errors(vectors, fits, vector) if fits else {}
    sent = vectors.sparkSession.sparkContext.broadcast((fits, errors))
    kind = vectors.schema[id].dataType
    rows = vectors.where(usable(F.col(vector))).select(F.col(id).alias("id_"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, errors = sent.value
        for batch in batches:
            for d, own, x in _blocks(batch, 1):
                if d not in fits:
                    continue
                f, many = fits[d], len(own)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(own)), pa.array([f.n] * many, pa.int64()), pa.array(f.deviation(x), pa.int64()), pa.array(list(f.whitened(x)), pa.list_(pa.float64())),
                    pa.array([f.values / f.trace] * many, pa.list_(pa.float64())), pa.array([errors[d]] * many, pa.float64()),
                ], ["id_", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"id_ {kind.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double").withColumnRenamed("id_", id)


def whitened_components(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = whiten(vectors, id, vector, components)
    each = rows.select(id, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(id, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
