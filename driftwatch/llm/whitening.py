"""Embedding whitening: leading components by matrix-free block iteration, then each row in units of their deviation.

The covariance V is never formed. A Spark pass multiplies it with a block of b directions as the sum over tasks of
C'(CQ), C being a batch of centred rows: d rows of b numbers a task, whatever the number of vectors. Between passes the
driver keeps the blocks orthonormal (QR) and solves the small projected problem (Rayleigh-Ritz); what the best directions
still lack, their residuals, is the next block. It ends when the residuals of all k components, measured by a pass over the
components themselves, are down to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import staged

#: x = floor(SCALE * c) + SHIFT, and entries of LIMIT and more, whose x a long can't hold, count as not finite.
SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0**56
#: Components, and directions in a block, as a multiple of them.
COMPONENTS, WIDTH = 16, 2
#: Blocks kept before the basis is cut back to its best directions.
BLOCKS = 8
#: Residuals, as a part of the largest eigenvalue, that certify; eigenvalues that count as zero; passes at most.
TOLERANCE, ZERO, PASSES = 1e-13, 1e-13, 300
LONG = 2**63 - 1


def usable(vec: Column) -> Column:
    """Neither null nor empty, and without null or non-finite entries."""
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)), F.lit(False))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id and x of the usable rows. Vectors of another length than the commonest (of ties, the longest) are left out."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec")).where(usable(F.col("vec")))
    commonest = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform("vec", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("bigint"))
    return rows.where(F.size("vec") == (commonest.d if commonest else 0)).select("id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and sums by dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                small = int(np.abs(x).max()) * len(x) < 2**62
                n, sums = n + len(x), sums + x.sum(0, dtype=np.int64 if small else object).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(s) for s in (n, *sums)])], ["dim", "total"])

    found = fit.select("x").mapInArrow(run, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    values = [int(r.total) for r in sorted(found, key=lambda r: r.dim)]
    return (values[0], values[1:]) if values else (0, [])


class Centre:
    """Exact distances from the mean S / n: the whole part of the mean is taken off as a long, the rest n-fold."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x-S)^2; None beyond a long."""
        x = x - self.whole
        if x.size and x.shape[1] * (self.n * (int(np.abs(x).max()) + 1)) ** 2 <= LONG:
            return ((x * self.n - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(1)
        return [s if s <= LONG else None for s in exact]


def _summed(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of of(x), a matrix of that width: each task sums its own, Spark the tasks'."""
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(c) for c in total.T)], ["row", *names])

    parts = fit.select("x").mapInArrow(run, ", ".join(["row int", *(f"{n} double" for n in names)]))
    return np.array([r[1:] for r in sorted(parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).collect())])


def times(fit: DataFrame, centre: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """A pass: VQ, and V's trace."""

    def of(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        return np.hstack([c.T @ (c @ q), (c * c).sum(0)[:, None]])

    both = _summed(fit, q.shape[1] + 1, of) / centre.n
    return both[:, :-1], float(both[:, -1].sum())


def _orthonormal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Directions that block adds to basis. Columns that add less than least are noise."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    u, s, _ = np.linalg.svd(r)
    q = q @ u[:, s > least]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.size else q


def components(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k largest eigenvalues, falling, their unit vectors as columns, the largest residual relative to the largest
    eigenvalue, and the passes taken. multiply gives the covariance times a block.

    Directions of no variance are left out; so fewer than k may come back, none if nothing varies.
    """
    k, width = min(k, d), min(WIDTH * k, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    basis, image, passes, best, stuck = np.empty((d, 0)), np.empty((d, 0)), 0, np.inf, 0
    while True:
        basis, image, passes = np.hstack([basis, q]), np.hstack([image, multiply(q)]), passes + 1
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        if values[0] <= 0:
            return np.empty(0), np.empty((d, 0)), 0.0, passes
        vectors, own = basis @ y, image @ y
        lack = own - vectors * values
        residual = float(np.linalg.norm(lack[:, :k], axis=0).max() / values[0])
        whole = basis.shape[1] == d
        if residual <= TOLERANCE or whole:  # so far by images summed up from earlier passes: now by one of the components
            top = np.linalg.qr(vectors[:, :k])[0]
            own, passes = multiply(top), passes + 1
            small = top.T @ own
            values, y = np.linalg.eigh((small + small.T) / 2)
            values, top, own = values[::-1], top @ y[:, ::-1], own @ y[:, ::-1]
            residual = float(np.linalg.norm(own - top * values, axis=0).max() / values[0])
            stuck = 0 if residual < best / 2 else stuck + 1
            best = min(best, residual)
            if residual <= TOLERANCE or whole or stuck > 2 or passes >= PASSES:
                kept = values > ZERO * values[0]
                signs = np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
                return values[kept], (top * signs)[:, kept], residual, passes
            basis, image, lack = top, own, own - top * values
        elif passes >= PASSES:
            raise RuntimeError(f"not certified after {passes} passes: residual {residual:.2g}")
        elif basis.shape[1] >= BLOCKS * width:
            basis, image, lack = vectors[:, :width], own[:, :width], lack[:, :width]
        q = _orthonormal(lack[:, :width], basis, 1e-15 * values[0])
        if not q.size:  # the basis holds all that it can reach: go on from a fresh direction
            q = _orthonormal(np.random.default_rng(seed + passes).standard_normal((d, width)), basis, 1e-8)
        q = q[:, : d - basis.shape[1]]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Each usable row in the k leading components of the different vectors, in units of each component's deviation.

    Columns: the id, component (from 1), n (different vectors), deviation (null where it exceeds a long), whitened,
    explained, identity_error (of the covariance of whitened over the different vectors) and residual (largest, relative).
    Rows whose vector is null, empty, of another length than the commonest, or holds null, non-finite or entries of 2^56
    and more are left out. Repeated rows come as often as they stand and count once in the fit, as do rows of other ids
    with the same x. A null id stays null. Components without variance are left out: no rows when all vectors are equal.
    """
    rows = integer_vectors(df, id_col, vec_col)
    fit = staged(rows.select("x").distinct(), "fit")
    n, sums = totals(fit)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double"
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    centre, trace = Centre(n, sums), 0.0

    def multiply(q: np.ndarray) -> np.ndarray:
        nonlocal trace
        image, trace = times(fit, centre, q)
        return image

    values, vectors, residual, _ = components(multiply, len(sums), k)
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    onto = vectors / np.sqrt(values)

    def squares(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ onto
        return np.vstack([w.T @ w, w.sum(0)])

    moments = _summed(fit, len(values), squares) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(values))).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, m = _matrix(batch.column(1)), len(values)
                size, of = len(x) * m, np.repeat(np.arange(len(x)), m)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(of)), pa.array((centre.centred(x) @ onto).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error)), pa.array(np.full(size, residual)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return rows.mapInArrow(run, schema)
