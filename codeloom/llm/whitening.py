"""Whitening of embeddings: blockwise QR of centred rows, then a bidiagonal qd solver.

Every task reduces its centred rows to one triangular matrix, a tree of small
merges reduces those to one R, which is as large as the vectors are long and no
larger. Householder reflections bring R to two diagonals, dqds finds its
singular values, twisted factorisations the directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.exact_search import whole
from codeloom.llm.qd_svd import EPS, right_vectors
from codeloom.llm.tables import stored, temporary

SCALE = 64
OFFSET = 1_000_000
#: Entries count as at most this far from zero, so that they fit in 64 bits.
FARTHEST = 1 << 61
#: Triangles that one task merges.
FAN_IN = 16

_SUMS = "dim int, s decimal(38,0), n long"
_TRIANGLE = "r binary"


def integers(vectors: DataFrame) -> DataFrame:
    """Whole vectors with x, every entry ``floor(64 * c) + 1000000``."""
    far = F.lit(float(FARTHEST))
    entry = lambda c: F.floor(F.greatest(-far, F.least(far, F.lit(float(SCALE)) * c.cast("double")))) + F.lit(OFFSET)
    return vectors.filter(whole(F.col("embedding"))).select("vec_id", F.transform("embedding", entry).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, short ones filled up with what a zero becomes."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(column) and (np.diff(ends) == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.full((len(column), width), OFFSET, np.int64)
    for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[k, : high - low] = flat[low:high]
    return out


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where those do, else in Python's numbers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if most < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _centred(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, n * x - sums, the same over n in doubles)."""
    for batch in batches:
        exact = _offsets(_matrix(batch.column("x"), len(sums)), n, sums)
        yield batch, exact, (exact / n).astype(float)


def _summed(width: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            most = int(np.abs(x).max(initial=0)) * max(1, len(x))
            total = [a + int(b) for a, b in zip(total, x.astype(np.int64 if most < 1 << 62 else object).sum(axis=0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int32()), "s": pa.array(total, pa.decimal128(38, 0)), "n": pa.array([n] * width, pa.int64())})

    return work


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _reduced(n: int, sums: list[int]) -> Callable:
    """Centred rows of a task to one triangle, batch by batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(sums)))
        for _, _, rows in _centred(batches, n, sums):
            r = _triangle(np.concatenate((r, rows)))
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    return work


def _merged(width: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for cell in batch.column("r"):
                r = _triangle(np.concatenate((r, np.frombuffer(cell.as_py()).reshape(-1, width))))
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    return work


def fit(distinct: DataFrame, k: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(rows, sums per dimension, all eigenvalues, whitening directions as columns) of a table of distinct x."""
    width = distinct.agg(F.max(F.size("x")).alias("w")).first().w or 0
    summed = distinct.mapInArrow(_summed(width), _SUMS).groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect() if width else []
    if not summed:
        return 0, [], np.zeros(0), np.zeros((0, 0))
    n, sums = summed[0].n, [int(row.s) for row in sorted(summed, key=lambda row: row.dim)]
    triangles = stored(distinct.mapInArrow(_reduced(n, sums), _TRIANGLE), "triangles")
    while (parts := triangles.count()) > 1:
        triangles = stored(triangles.repartition(-(-parts // FAN_IN)).mapInArrow(_merged(width), _TRIANGLE), "triangles")
    r = np.zeros((width, width))
    got = np.frombuffer(triangles.first().r).reshape(-1, width)
    r[: len(got)] = got
    squares, vectors = right_vectors(r, k)
    values = squares / n
    # What rounding leaves of a direction in which nothing varies has no whitening.
    real = values[: vectors.shape[1]] > (width * EPS) ** 2 * (1 + values[0]) if len(values) else np.zeros(0, bool)
    return n, sums, values, vectors[:, real] / np.sqrt(values[: vectors.shape[1]][real])


def _covered(n: int, sums: list[int], directions: np.ndarray) -> Callable:
    """Sums of products of the whitened rows, of a task."""
    k = directions.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, _, rows in _centred(batches, n, sums):
            z = rows @ directions
            total += z.T @ z
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total.ravel())})

    return work


def _identity_error(distinct: DataFrame, n: int, sums: list[int], directions: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    covered = distinct.mapInArrow(_covered(n, sums, directions), "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") / n).alias("v"))
    off = F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return float(covered.agg(F.max(F.abs(off)).alias("e")).first().e)


def _whitened(n: int, sums: list[int], directions: np.ndarray, explained: list[float], error: float) -> Callable:
    k = directions.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, exact, rows in _centred(batches, n, sums):
            m = len(rows)
            far = np.abs(exact.astype(float)).max(initial=0) ** 2 * max(1, len(sums)) >= 2.0**62
            squares = np.square(exact.astype(object) if far else exact).sum(axis=1)
            deviation = pa.array([int(d) if d < 1 << 63 else None for d in squares], pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, n)),
                "deviation": deviation,
                "whitened": pa.array((rows @ directions).ravel()),
                "explained": pa.array(explained * m, pa.float64()),
                "identity_error": pa.array(np.full(m * k, error)),
            })

    return work


def whiten(vectors: DataFrame, k: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    ``vectors`` has vec_id and embedding; other columns are not read. Vectors that
    are null or hold a null or an entry that is not finite are left out. The fit
    takes every distinct x once; repeated rows and rows under one vec_id all get
    results. Where lengths differ, missing entries are those of c = 0. Directions
    in which nothing varies have no component, so one vector alone, or only equal
    or empty ones, give no rows, and neither does an empty table. Equal
    eigenvalues have any basis of their space. Entries beyond 2^61 count as
    2^61; a deviation beyond 64 bits is null.

    Only sums, one triangle per merge, and the directions, all bounded by the
    length of the vectors, leave the tasks. ``identity_error`` is measured by a
    second pass over the whitened fit list.
    """
    spark = vectors.sparkSession
    rows = integers(vectors)
    types = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with temporary(spark):
        distinct = stored(rows.select("x").distinct(), "distinct")
        n, sums, values, directions = fit(distinct, k)
        if not directions.size:
            return spark.createDataFrame([], types)
        error = _identity_error(distinct, n, sums, directions)
    explained = (values[: directions.shape[1]] / values.sum()).tolist()
    return rows.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(_whitened(n, sums, directions, explained, error), types)
