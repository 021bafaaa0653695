"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are taken as whole numbers x = floor(scale * c), so sums and the scatter are exact in any order of the rows. With
the scatter P' V P = L L', Jacobi rotations make the columns of L orthogonal: their squared norms are the eigenvalues of V
and the normalised columns, with the pivoting undone, its eigenvectors. V itself is never squared or diagonalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.shared import drop, table

_LOW = 1 << 60  # sums travel as high * 2^60 + low, which no count of rows overflows


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums per dimension; eigenvalues, and unit components as rows, falling; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as bytes; equal vectors give equal bytes, as each takes the narrowest type that holds it."""
    low, high = int(x.min()), int(x.max())
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(packed: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as rows of a matrix."""
    return np.stack([np.frombuffer(p, dtype=f"<i{p[0]}", offset=1).astype(np.int64) for p in packed])


def packed(rows: DataFrame, vec_id: Column, vector: Column, scale: int) -> DataFrame:
    """vec_id, size, x of the rows whose vector has entries, all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            for i, entry in enumerate(batch.column(1)):
                if not entry.is_valid or not len(entry):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(entry.values.to_numpy(zero_copy_only=False) * float(scale))
                if (np.abs(x) < 2.0**63).all():
                    kept.append(i)
                    found.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([len(x) for x in found], pa.int32()),
                                              pa.array([pack(x) for x in found], pa.binary())], names=["vec_id", "size", "x"])

    source = rows.select(vec_id.alias("vec_id"), vector.cast("array<double>").alias("vector"))
    return source.mapInArrow(run, f"vec_id {source.schema['vec_id'].dataType.simpleString()}, size int, x binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return unpack(batch.column(batch.schema.get_field_index("x")).to_pylist())


def _exact(y: np.ndarray, other: np.ndarray) -> np.ndarray:
    """y' other without rounding: in doubles while every sum stays below 2^53, else in Python's integers."""
    most = int(np.abs(y).max()) * int(np.abs(other).max()) * len(y)
    if most < 1 << 53:
        return (y.astype(np.float64).T @ other.astype(np.float64)).astype(np.int64).astype(object)
    return y.astype(object).T @ other.astype(object)


def _exact_sums(fit: DataFrame, of, length: int) -> list[int]:
    """Sums over the fit list of the `length` whole numbers that of(matrix of rows) gives for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype=object)
        for batch in batches:
            if batch.num_rows:
                total = total + of(_matrix(batch))
        parts = [divmod(int(v), _LOW) for v in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), *(pa.array([Decimal(p[k]) for p in parts], pa.decimal128(38, 0)) for k in (0, 1))], names=["at", "high", "low"])

    added = fit.mapInArrow(run, "at int, high decimal(38,0), low decimal(38,0)").groupBy("at").agg(F.sum("high"), F.sum("low"))
    out = [0] * length
    for at, high, low in added.collect():
        out[at] = int(high) * _LOW + int(low)
    return out


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L L'; as many columns as the numerical rank."""
    d = len(matrix)
    rest, order, factor = matrix.copy(), np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(np.diag(matrix).max(initial=0.0), 0.0)
    for k in range(d):
        pivot = k + int(np.argmax(np.diag(rest)[k:]))
        if not rest[pivot, pivot] > least:
            return factor[:, :k], order
        for a in (rest, factor):
            a[[k, pivot]] = a[[pivot, k]]
        rest[:, [k, pivot]] = rest[:, [pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1:, k] = rest[k + 1:, k] / factor[k, k]
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """factor times rotations, with orthogonal columns. A round rotates disjoint pairs of columns at once; every pair meets once a sweep."""
    a = factor.copy()
    n = a.shape[1]
    ring = list(range(n + n % 2))
    tiny = len(a) * np.finfo(float).eps
    for _ in range(100):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(ring[i], ring[-1 - i]) for i in range(len(ring) // 2)]
            p, q = np.array([x for x in pairs if max(x) < n], dtype=int).reshape(-1, 2).T
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            some = np.abs(gamma) > tiny * np.sqrt(alpha * beta)
            if some.any():
                turned = True
                left, right, p, q = left[:, some], right[:, some], p[some], q[some]
                zeta = (beta[some] - alpha[some]) / (2 * gamma[some])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * left - c * t * right, c * t * left + c * right
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if not turned:
            return a
    raise ArithmeticError("the rotations did not settle in 100 sweeps")


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, up to the numerical rank. A vector's largest entry is positive."""
    factor, order = pivoted_cholesky(covariance)
    columns = orthogonal_columns(factor)
    values = (columns * columns).sum(axis=0)
    falling = np.argsort(-values, kind="stable")
    vectors = np.zeros((len(falling), len(covariance)))
    vectors[:, order] = (columns[:, falling] / np.sqrt(values[falling])).T
    largest = np.abs(vectors).argmax(axis=1)
    return values[falling], vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


def fit_whitening(fit: DataFrame, components: int | None = None) -> Whitening | None:
    """Fitted on the distinct packed vectors `fit` (size, x); None where they do not vary.

    Where lengths differ, the length of most vectors counts (the greater of equally frequent ones). What reaches the driver
    are one row for each length, d sums and the d (d + 1) / 2 entries of the scatter of dimension d, added up in Spark.
    """
    sizes = fit.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return None
    d, n = sizes["size"], sizes["n"]
    fit = fit.filter(F.col("size") == d)
    sums = _exact_sums(fit, lambda x: _exact(np.ones((len(x), 1), dtype=np.int64), x)[0], d)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)  # the mean to the nearest whole number
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        y = x - middle if int(np.abs(x).max()) < 1 << 61 else x.astype(object) - middle.astype(object)
        return _exact(y, y)[upper]

    scatter, off = np.zeros((d, d), dtype=object), np.array([s - n * int(m) for s, m in zip(sums, middle)], dtype=object)
    scatter[upper] = _exact_sums(fit, products, len(upper[0]))
    scatter.T[upper] = scatter[upper]
    centred = n * scatter - np.outer(off, off)  # n^2 times the covariance, exact
    covariance = np.array([[v / (n * n) for v in row] for row in centred], dtype=np.float64)
    values, vectors = principal(covariance)
    if not len(values):
        return None
    return Whitening(n, tuple(sums), values[:components], vectors[:components], sum(centred.diagonal().tolist()) / (n * n))


def identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from a pass over that list."""
    k, d = len(fitted.eigenvalues), len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                w = fitted.apply(_matrix(batch))
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "value"])

    added = fit.filter(F.col("size") == d).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    flat = np.array([r["value"] for r in added.orderBy("at").collect()]) / fitted.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each row, exact; None where it needs more than 64 bits."""
    peak, most = int(np.abs(x).max()), max(map(abs, sums))
    if x.shape[1] * (n * peak + most) ** 2 < 1 << 63:
        z = n * x - np.array(sums, dtype=np.int64)
        return (z * z).sum(axis=1).tolist()
    wide = x if x.shape[1] * max(peak, 1) * max(peak, most) < 1 << 63 else x.astype(object)
    squares, cross = (wide * wide).sum(axis=1).astype(object), (wide * np.array(sums, dtype=wide.dtype)).sum(axis=1).astype(object)
    exact = n * n * squares - 2 * n * cross + sum(s * s for s in sums)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whiten(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", *, components: int | None = 4, scale: int = 256) -> tuple[DataFrame, Whitening | None]:
    """(one row per vector: vec_id, n, deviation, whitened array, explained array, identity_error; the fitted model).

    The model is fitted on each distinct vector once, so a vector that a third of all rows repeat counts once and is thinned
    before the shuffle. Rows are then whitened where they lie. The fit list is a written table, deleted when it has served.

    Defined results: a vector that is null, empty, holds null or non-finite entries, or entries whose floor needs more than
    64 bits, gives no row; nor do vectors of another length than most distinct ones have; rows without an id and rows that
    repeat one each give theirs; components stop at the numerical rank, so vectors that do not vary (one distinct vector, or
    none, or an empty table) give no rows; deviation is null where it needs more than 64 bits; other columns are not read.
    """
    cells = packed(rows, F.col(vec_id), F.col(vector), scale)
    fit = table(cells.select("size", "x").distinct(), "fit")
    fitted = fit_whitening(fit, components)
    error = identity_error(fit, fitted) if fitted else None
    drop(fit)
    id_type = cells.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema), None
    shares = (fitted.eigenvalues / fitted.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch) if m else np.zeros((0, len(fitted.sums)), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([fitted.n] * m, pa.int64()), pa.array(deviations(x, fitted.n, fitted.sums) if m else [], pa.int64()),
                pa.array(list(fitted.apply(x)), pa.list_(pa.float64())), pa.array([shares] * m, pa.list_(pa.float64())), pa.array([error] * m, pa.float64())],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return cells.filter(F.col("size") == len(fitted.sums)).mapInArrow(run, schema), fitted
