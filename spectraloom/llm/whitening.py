"""Embedding whitening by FEAST: contour integration over the covariance's resolvent.

Vectors are quantised to integers, so sums and centred second moments are exact: they are summed
about the rounded mean, and the rest of the mean (half a unit at most) is taken off in integer
arithmetic. Executors sum blocks of rows; the driver holds matrices of dimension x dimension alone.

FEAST: the leading eigenvalues are enclosed in intervals by inertia counts; a quadrature over
the circle on an interval, (1 / 2 pi i) * integral of (z I - V)^-1 Y dz, projects a block of vectors onto its
eigenspace, Rayleigh-Ritz on the projected block gives eigenpairs, and both repeat until the residuals
are at double precision. The inertia of V - shift I at both ends says how many there must be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import arrow_schema, materialize

SCALE = 256
#: Entries beyond this are refused: their long would be wrong.
LARGEST = 1 << 62
#: Quadrature nodes on the upper half circle, and rounds at most.
NODES, ROUNDS = 16, 60
#: A component's share of the trace below which it is rounding, per dimension.
NOISE = float(np.finfo(float).eps)


def quantised(rows: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """columns and x, array<bigint> of floor(256 * c), of the rows whose embedding is whole: not null or empty, no null, NaN or infinite entry."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    scaled = lambda c: F.floor(F.when(F.abs(c.cast("double") * SCALE) < float(LARGEST), c.cast("double") * SCALE).otherwise(F.raise_error(F.lit("an embedding's entry is too large")).cast("double"))).cast("long")
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select(*columns, F.transform("embedding", scaled).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dims)


def _exact(a: np.ndarray, top: int) -> np.ndarray:
    """a as it is if products' sums up to `top` fit 63 bits, else as Python integers."""
    return a if top < 1 << 63 else a.astype(object)


def _sums(fit: DataFrame, dims: int, centre: list[int] | None) -> dict:
    """Exact sums over fit: of x by dimension, or, about centre, of all products (i <= j)."""
    schema = "i int, j int, s decimal(38,0)"
    out = arrow_schema(fit.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims) if centre else dims, object)
        for b in batches:
            x = _matrix(b.column(0), dims)
            if not len(x):
                continue
            if centre is None:
                total += _exact(x, int(np.abs(x).max()) * len(x)).sum(0)
                continue
            y = _exact(x, 2 * LARGEST - 1) - np.array(centre, np.int64)
            top = int(np.abs(y).max()) ** 2 * len(y)
            if top < 1 << 53:  # every partial sum is a whole number that a double holds exactly
                y = y.astype(float)
                total += (y.T @ y).astype(np.int64)
            else:
                y = y.astype(object)
                total += y.T.dot(y)
        i, j = np.triu_indices(dims) if centre else (np.arange(dims),) * 2
        values = [Decimal(int(v)) for v in (total[i, j] if centre else total)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], schema=out)

    rows = fit.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # dimension ** 2 / 2 at most
    return {(r.i, r.j): int(r.s) for r in rows}


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix by Householder reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        q = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, q) + np.outer(q, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(band: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues exceed shift: the positive pivots of T - shift I (Sylvester's law of inertia)."""
    diagonal, off = band
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    found, pivot = 0, 1.0
    for k, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        found += pivot > 0
    return found


def _edge(band, count: int, low: float, high: float) -> tuple[float, float]:
    """Neighbouring shifts about the count-th largest eigenvalue: at least `count` lie above the first, fewer above the second."""
    while True:
        middle = (low + high) / 2
        if not low < middle < high:
            return low, high
        low, high = (middle, high) if above(band, middle) >= count else (low, middle)


def feast(a: np.ndarray, low: float, high: float, many: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs with low < eigenvalue < high of a symmetric matrix, by falling eigenvalue; many: how many there are."""
    n = len(a)
    width = min(n, max(many + 4, many * 3 // 2))
    block = np.random.default_rng(seed).standard_normal((n, width))
    node, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (node + 1) / 2)
    centre, radius, norm = (low + high) / 2, (high - low) / 2, np.linalg.norm(a)
    for _ in range(ROUNDS):
        projected = np.zeros((n, width))
        for t, w in zip(turn, weight, strict=True):
            solved = np.linalg.solve((centre + radius * t) * np.eye(n) - a, block.astype(complex))
            projected += (w / 2 * radius * t * solved).real
        basis, _ = np.linalg.qr(projected)
        value, vector = np.linalg.eigh(basis.T @ a @ basis)
        block = basis @ vector
        inside = np.flatnonzero((value > low) & (value < high))[::-1]
        if len(inside) == many:
            rest = np.linalg.norm(a @ block[:, inside] - block[:, inside] * value[inside], axis=0)
            if rest.max(initial=0) <= 8 * n * np.finfo(float).eps * norm:
                return value[inside], block[:, inside]
    raise ArithmeticError(f"{many} eigenvalues lie between {low} and {high}, the projection holds {len(inside)} or has not settled")


def _groups(at: list[float], i: int, j: int, top: float, tied: float) -> Iterator[tuple[int, int]]:
    """Ranges of the falling eigenvalues `at` for one interval each: cut at the widest gap while a range is wide beside what separates it from the others."""
    outer = min((at[i - 1] if i else top) - at[i], at[j - 1] - at[j])
    gaps = [at[k] - at[k + 1] for k in range(i, j - 1)]
    if not gaps or at[i] - at[j - 1] <= 20 * outer or max(gaps) <= tied:
        yield i, j
        return
    cut = i + 1 + int(np.argmax(gaps))
    yield from _groups(at, i, cut, top, tied)
    yield from _groups(at, cut, j, top, tied)


def components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues above rounding and their unit vectors (columns; the largest entry is positive)."""
    n = len(a)
    trace = float(np.trace(a))
    band = tridiagonal(a)
    bound = float(np.abs(a).sum(1).max()) * (1 + 1e-9)
    floor = n * NOISE * trace
    wanted = min(most, above(band, floor)) if trace > 0 else 0
    if not wanted:
        return np.zeros(0), np.zeros((n, 0))
    slack = 4 * n * NOISE * bound
    at = [_edge(band, k + 1, -bound, bound)[0] for k in range(wanted)]
    while len(at) < n:  # tied eigenvalues stay together; the last place is the first eigenvalue outside
        at.append(_edge(band, len(at) + 1, -bound, bound)[0])
        if at[-2] - at[-1] > 8 * slack:
            break
    else:
        at.append(at[-1] - max(bound * 1e-3, 16 * slack))
    many = len(at) - 1
    top = at[0] + max((at[0] - at[-1]) * 0.1, 16 * slack)
    blocks = []
    for i, j in _groups(at, 0, many, top, 8 * slack):
        beyond, before, span = ((at[i - 1] - at[i]) / 2 if i else top - at[i]), (at[j - 1] - at[j]) / 2, at[i] - at[j - 1]
        high, low = at[i] + min(beyond, max(span, before)), at[j - 1] - min(before, max(span, beyond))
        blocks.append(feast(a, low, high, above(band, low) - above(band, high))[1])
    basis, _ = np.linalg.qr(np.hstack(blocks))
    value, vector = np.linalg.eigh(basis.T @ a @ basis)
    value, vector = value[::-1][:wanted], (basis @ vector)[:, ::-1][:, :wanted]
    return value, vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(wanted)])


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates: the exact x - S / n, rounded once, on the components."""
        centre = [-(-s // self.n) for s in self.sums]
        rest = np.array([(s - c * self.n) / self.n for s, c in zip(self.sums, centre, strict=True)])
        y = (x - np.array(centre, np.int64)).astype(float) - rest
        return y @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - S) ** 2."""
        top = (self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))) ** 2 * x.shape[1]
        d = _exact(x, top) * self.n - np.array(self.sums, np.int64 if top < 1 << 63 else object)
        return (d * d).sum(1).tolist()


def fit(vectors: DataFrame, most: int) -> Whitening | None:
    """The model of distinct x vectors; None if there are none."""
    shape = vectors.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("dims")).first()
    if not shape.n:
        return None
    if shape.least != shape.dims:
        raise ValueError(f"vectors have {shape.least} to {shape.dims} entries")
    n, dims = shape.n, shape.dims
    sums = [s for _, s in sorted(_sums(vectors, dims, None).items())]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _sums(vectors, dims, centre)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((dims, dims))
    for (i, j), s in products.items():
        v[i, j] = v[j, i] = (n * s - rest[i] * rest[j]) / (n * n)  # whole numbers until here
    values, found = components(v, most)
    return Whitening(n, sums, values, found, float(np.trace(v)))


def whiten(rows: DataFrame, most: int = 4) -> DataFrame:
    """Per row and component up to `most`: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose embedding is null, empty or holds null or non-finite entries are left out; repeated rows are each returned and count
    once in the fit. Components whose variance is rounding (all vectors equal: every one) are not returned, so
    an empty table gives no rows. Vectors of several lengths, entries beyond 2**54 and deviations beyond 64 bits are
    errors. Further columns are not read. The order among components of equal eigenvalue is arbitrary, but the same for all rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    distinct = materialize(quantised(rows).distinct(), "vectors")
    model = fit(distinct, most)
    k = 0 if model is None else len(model.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema + ", identity_error double")
    dims = len(model.sums)
    plain = arrow_schema(rows.sparkSession, "w array<double>")
    out = arrow_schema(rows.sparkSession, schema)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.project(_matrix(b.column(0), dims))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel())).cast(plain[0].type)], schema=plain)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            size = len(x)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(size), k)))
            columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), size), np.full(size * k, model.n), np.repeat(np.array(model.deviation(x), np.int64), k), model.project(x).ravel(), np.tile(model.values / model.trace, size)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *map(pa.array, columns)], schema=out)

    w = distinct.mapInArrow(coordinates, "w array<double>")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = w.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    return quantised(rows, ("vec_id",)).mapInArrow(results, schema).withColumn("identity_error", F.lit(float(error)))
