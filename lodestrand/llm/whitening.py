"""Whitening of embeddings by a spectral divide-and-conquer.

Counts, sums and the covariance come from one pass each over all rows, as partial sums of a
task that Spark adds up by position. Vectors are integers x = floor(1024 * c) + 100000, sums are exact, and the
covariance is taken of x less the rounded mean, so its sums are exact too while they stay
below 2**53 (beyond, they are rounded as doubles are), whatever the number of partitions.

The covariance (a square of the dimensions, whatever the number of rows) is split on the
driver: QDWH iterations give the polar factor U of V - shift * I without inverses, the
projector (U + I) / 2 belongs to the eigenvalues above the shift, orthonormal bases of its
range and of the rest cut V into two smaller matrices, and so on until each has one
component. Parts that can only hold components after the last one asked for are left alone.
The components, a matrix of `most` columns, go to all tasks, which write each row's values.

Rows with a null vector or with null or non-finite entries are left out, and so are rows of
another length than the commonest one (of equally common ones the longest). Null and repeated
ids and repeated rows are kept as they come. Entries beyond what a long holds are taken as the nearest long.
Components of no variance (fewer rows than dimensions, equal or constant entries) have null values, as there is
nothing to scale them by. An empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Rows that a task holds as doubles at a time.
ROWS = 4096
_EPS = float(np.finfo(float).eps)


# --- components of a symmetric matrix ---------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    x = a / np.linalg.norm(a)
    least = _EPS  # a lower bound of the singular values; one below it takes further iterations
    for _ in range(60):
        d = (4 * (1 - least**2) / least**4) ** (1 / 3)
        h = (1 + d) ** 0.5 + 0.5 * (8 - 4 * d + 8 * (2 - least**2) / (least**2 * (1 + d) ** 0.5)) ** 0.5
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q = np.linalg.qr(np.vstack([c**0.5 * x, np.eye(n)]))[0]
        y = b / c * x + (h - b / c) / c**0.5 * (q[:n] @ q[n:].T)
        least = min(1.0, least * (h + b * least**2) / (1 + c * least**2))
        y = (y + y.T) / 2
        moved, x = np.linalg.norm(y - x), y
        if moved <= (5 * _EPS) ** (1 / 3) * 1e-3 and abs(1 - least) <= 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Orthonormal bases for the eigenvalues above and below the shift, and how much of `a` still couples them."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(float(np.trace(projector))))
    if not 0 < k < n:
        return np.zeros((n, 0)), np.eye(n), np.inf
    start = np.random.default_rng(n).standard_normal((n, k))
    q = np.linalg.qr(projector @ np.linalg.qr(projector @ start)[0], mode="complete")[0]
    return q[:, :k], q[:, k:], float(np.linalg.norm(q[:, k:].T @ a @ q[:, :k]))


def components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    values, vectors = [], []
    whole = max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    left = [(a, np.eye(len(a)))]  # the greatest eigenvalues on top
    while left and len(values) < most:
        part, basis = left.pop()
        n = len(part)
        if n == 1:
            values.append(float(part[0, 0]))
            vectors.append(basis[:, 0])
            continue
        if np.linalg.norm(part - np.diag(np.diag(part))) <= 4 * _EPS * whole:  # all that is left is rounding: any basis will do
            order = np.argsort(-np.diag(part), kind="stable")
            values += [float(v) for v in np.diag(part)[order]]
            vectors += [basis[:, k] for k in order]
            continue
        diagonal = np.diag(part)
        reach = float(np.linalg.norm(part - np.diag(diagonal)))
        tries = [float(np.median(diagonal)), float(diagonal.mean()), *(float(diagonal.mean()) + reach * f / 16 for f in (1, -1, 3, -3, 5, -5, 7, -7))]
        best = min((_split(part, shift) for shift in tries[:2]), key=lambda s: s[2])
        for shift in tries[2:]:
            if best[2] <= 64 * _EPS * whole:
                break
            best = min(best, _split(part, shift), key=lambda s: s[2])
        above, below, coupled = best
        if not np.isfinite(coupled):
            raise ArithmeticError("no shift splits the covariance")
        for q in (below, above):
            inner = q.T @ part @ q
            left.append(((inner + inner.T) / 2, basis @ q))
    return np.array(values[:most]), np.array(vectors[:most]).T.reshape(len(a), -1)


# --- passes over the rows ---------------------------------------------------------------------


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *also: Column) -> DataFrame:
    """id, c (array of doubles) and `also` of the rows that take part; vectors of another length than the commonest are left out."""
    c = F.col(vector_col).cast("array<double>")
    lost = F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), c.alias("c"), *also).filter(F.col("c").isNotNull() & ~lost & (F.size("c") > 0))
    size = rows.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("c") == (size[0] if size else 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and integer vectors of at most ROWS rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * c)
            big = np.abs(x) >= 2.0**62
            yield part.column(0), np.where(big, np.where(x > 0, 2**63 - 1, -(2**63)), np.where(big, 0, x).astype(np.int64) + SHIFT)


def _exact(x: np.ndarray, rows: int) -> np.ndarray:
    """Integers as they are where sums of so many of them fit a long, else as Python's."""
    return x if x.size == 0 or max(abs(int(x.max())), abs(int(x.min()))) * max(rows, 1) < 2**62 else x.astype(object)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for _, x in _blocks(batches):
            n, total = n + len(x), total + _exact(x, len(x)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total) + 1), pa.int32()), pa.array([Decimal(int(v)) for v in [n, *total]], pa.decimal128(38, 0))], names=["at", "total"])

    found = dict(rows.mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect())
    return (int(found[0]), [int(found[k]) for k in range(1, len(found))]) if found else (0, [])


def _products(rows: DataFrame, made, size: int) -> np.ndarray:
    """The sum over all rows of y y^T, for the rows y that `made` gives of a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in _blocks(batches):
            y = made(x)
            total += y.T @ y
        at = np.arange(size * size).reshape(size, size)[np.triu_indices(size)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.reshape(-1)[at])], names=["at", "total"])

    found = rows.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size * size)
    out[found.column("at").to_numpy()] = found.column("total").to_numpy()
    out = out.reshape(size, size)
    return np.triu(out) + np.triu(out, 1).T


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """id, component (from 1), n, deviation decimal(38,0), whitened, explained and identity_error for each row and component."""
    rows = vectors(df, id_col, vector_col)
    n, total = sums(rows)
    size = len(total)
    pivot = [(2 * s + n) // (2 * n) for s in total]  # the rounded mean
    rest = np.array([float(s - p * n) / n for s, p in zip(total, pivot, strict=True)])

    def centred(x: np.ndarray) -> np.ndarray:
        p = np.array(pivot, object)
        return (x.astype(object) - p).astype(float) if max(map(abs, pivot)) >= 2**52 or np.abs(x.astype(float)).max() >= 2.0**52 else (x - p.astype(np.int64)).astype(float)

    if n:
        covariance = _products(rows, centred, size) / n - np.outer(rest, rest)
        trace = float(np.trace(covariance))
        values, columns = components(covariance, min(most, size))
        spread = values > size * _EPS * max(float(values[0]), 0.0) * 16
        scaled = columns * np.where(spread, 1 / np.sqrt(np.where(spread, values, 1.0)), 0.0)
        used = int(spread.sum())
        identity = _products(rows, lambda x: np.hstack([(y := (centred(x) - rest) @ scaled), np.ones((len(y), 1))]), len(values) + 1) / n
        mean = identity[:-1, -1]
        error = float(np.abs((identity[:-1, :-1] - np.outer(mean, mean))[:used, :used] - np.eye(used)).max()) if used else None
        explained = [float(v) / trace if trace > 0 else None for v in values]
    else:
        scaled, spread, explained, error, trace = np.zeros((0, 0)), np.zeros(0, bool), [], None, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for ids, x in _blocks(batches):
            y = (centred(x) - rest) @ scaled
            far = [max(abs(n * int(v) - s) for v in (lo, hi)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), total, strict=True)]
            off = x * n - np.array(total) if sum(f * f for f in far) < 2**63 and max(map(abs, total), default=0) < 2**62 and n * int(np.abs(x.astype(float)).max()) < 2**62 else x.astype(object) * n - np.array(total, object)
            squares = (off * off).sum(axis=1)
            deviation = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0), safe=False) if squares.dtype != object else pa.array([Decimal(int(v)) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(len(x)), k))
            flat = lambda v, kind: pa.array(v * len(x), kind)
            yield pa.RecordBatch.from_arrays(
                [ids.take(again), flat(list(range(1, k + 1)), pa.int32()), pa.array(np.full(len(x) * k, n)), deviation.take(again), pa.array(y.reshape(-1), mask=np.tile(~spread, len(x))), flat(explained, pa.float64()), flat([error] * k, pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of whitened over all embeddings; a deviation that no long holds is null."""
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")
