"""Embedding whitening by the cyclic Jacobi method.

Executors sum up the vectors, then the products of the centred ones (a matrix of dims x dims for each
partition, added up row by row in a shuffle). The driver only ever holds that matrix. It applies
symmetric Jacobi rotations, sweep by sweep, until what stands off the diagonal vanishes against the
diagonal itself, which gives small eigenvalues with the same care as large ones. The whitening
matrix (dims x components) is broadcast and rows are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import read, ship_code
from terrace.llm.vectors import matrix, padded, whole

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this have no exact whole-number form.
LARGEST = float(1 << 42)
SUMS = "dim int, n bigint, sum bigint"
PRODUCTS = "dim int, row array<double>"


def jacobi(symmetric: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), largest first, by cyclic Jacobi rotations.

    A rotation is left out once its entry is below the rounding of both diagonal entries that it
    would change; a sweep without rotations ends the work.
    """
    a, n = np.array(symmetric, np.float64), len(symmetric)
    v, tiny = np.eye(n), np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = 0
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if off == 0 or abs(off) <= 0.25 * tiny * np.sqrt(abs(a[p, p]) * abs(a[q, q])):
                    continue
                turned += 1
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(1.0, theta))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                ap, aq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * ap - s * aq, s * ap + c * aq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                vp, vq = v[:, p].copy(), v[:, q].copy()
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


@dataclass
class Whitening:
    """What the fit gives: n, whole-number sums a dimension, all eigenvalues, the whitening matrix
    (dims x components, each column an eigenvector over the root of its eigenvalue), explained
    shares, and the error found by measuring the whitened rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return self.sums.astype(np.float64) / max(self.n, 1)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, without null or non-finite entries and within the range of whole numbers."""
    return rows.filter(whole(F.col(vector))).filter(~F.exists(vector, lambda c: F.abs(c) > LARGEST))


def _added(partial: DataFrame, dims: int) -> np.ndarray:
    """The sum of (dim, row) over all partitions: rows of one dim meet in one small group."""
    got = np.zeros((dims, dims))
    summed = partial.select("dim", F.posexplode("row").alias("other", "x")).groupBy("dim", "other").agg(F.sum("x").alias("x"))
    for r in summed.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("other", "x"))).alias("row")).collect():
        got[r["dim"]] = [e["x"] for e in r["row"]]
    return got


def fit(rows: DataFrame, dims: int, vector: str = "vector", components: int = 8) -> Whitening:
    """Fits the whitening of all rows. Components of no variance (nothing beside the rounding of the
    largest) are left out, so one row, or equal rows, have none."""
    ship_code(rows.sparkSession)
    vectors = rows.select(vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for b in batches:
            n, total = n + b.num_rows, total + _steps(matrix(b.column(0), dims)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total, pa.int64())], names=["dim", "n", "sum"])

    got = {r["dim"]: r for r in vectors.mapInArrow(sums, SUMS).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect()}
    n = got[0]["n"] if got else 0
    if not n:
        return Whitening(0, np.zeros(dims, np.int64), np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
    found = Whitening(n, np.array([got[d]["sum"] for d in range(dims)], np.int64), np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
    scatter = _added(vectors.mapInArrow(_products(found.centre, dims), PRODUCTS), dims) / n
    values, axes = jacobi((scatter + scatter.T) / 2)
    some = int((values[:components] > max(values[0], 0) * 1e-13 * dims).sum()) if values[0] > 0 else 0
    found.values, found.explained = values, values[:some] / values.sum() if some else np.zeros(0)
    found.projection = axes[:, :some] / np.sqrt(values[:some])
    if some:
        # Measured over all rows, not derived from the matrix.
        covariance = _added(vectors.mapInArrow(_products(found.centre, dims, found.projection), PRODUCTS), some) / n
        found.identity_error = float(np.abs(covariance - np.eye(some)).max())
    return found


def _products(centre: np.ndarray, dims: int, projection: np.ndarray | None = None):
    """Each partition's sum of products of the centred rows (projected, if asked), a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims if projection is None else projection.shape[1],) * 2)
        for b in batches:
            y = _steps(matrix(b.column(0), dims)) - centre
            y = y if projection is None else y @ projection
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["dim", "row"])

    return run


def whiten(rows: DataFrame, by: Whitening, dims: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(vec_id, whitened array, deviation) for each row: the projections on all components, and the
    exact sum of squares of n * x - S, null where it is beyond a long."""
    ship_code(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for b in batches:
            x = _steps(matrix(b.column(1), dims))
            out = (x - fitted.centre) @ fitted.projection
            # Python's whole numbers where 64 bits could be too few.
            far = fitted.n * np.abs(x).max(initial=0).astype(float) + np.abs(fitted.sums).max(initial=0)
            y = x * fitted.n - fitted.sums if far < 2.0**62 else x.astype(object) * fitted.n - fitted.sums.astype(object)
            if float(np.abs(y).max(initial=0)) ** 2 * max(dims, 1) < 2.0**62:
                deviation = (y * y).sum(axis=1)
            else:
                deviation = (y.astype(object) ** 2).sum(axis=1)
            told = [int(d) if d < 1 << 63 else None for d in deviation]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64())), pa.array(told, pa.int64())], names=["vec_id", "whitened", "deviation"])

    schema = f"vec_id {rows.schema[vec_id].dataType.simpleString()}, whitened array<double>, deviation bigint"
    return rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).mapInArrow(run, schema)


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row
    and component.

    Rows whose vector is null, holds null or non-finite entries, or entries beyond 2**42 (no exact
    whole number) take no part. Shorter vectors are filled up with zeros to the longest one. Repeated
    rows and ids, and null ids, stay rows of their own; other columns are not looked at. Without
    rows, or where no component varies, the result is empty. deviation is null beyond a long.
    """
    kept, dims = padded(usable(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), "vector"))
    by = fit(kept, dims, components=components)
    each = whiten(kept, by, dims)
    explained = F.array(*[F.lit(float(e)) for e in by.explained]) if len(by.explained) else F.lit(None).cast("array<double>")
    return each.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(by.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(by.identity_error).alias("identity_error"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings, whitened on the eight strongest components."""
    return whitened(read(spark, sf_dir, "embeddings"))
