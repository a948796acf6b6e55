"""Approximate nearest neighbours: an inverted index whose probed lists are scanned dimension by dimension.

Vectors are dealt into lists by their nearest centroid and stored rotated, in blocks of columns. After a random rotation
the first s of d coordinates tell how far two vectors are from each other up to a known spread; a candidate whose partial
distance is too large for that hypothesis, given the distance that it has to beat, is abandoned before its other blocks are
looked at. What is left is measured on the original vectors. The bound to beat comes from a query's nearest list.

Lists are cut into cells of bounded size, so a list may hold any part of all rows; a task holds a cell and a batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import staged

#: The bounded sample to which centroids and the number of probed lists are fitted: rows, and bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Lists: the root of the number of rows, within these.
LISTS = (1, 1024)
#: Rows of a cell: a part of all, within these.
CELL_PART, CELL_ROWS = 2048, (256, 16384)
#: Of the sample's true neighbours, how many the probed lists must hold; queries of the sample that measure it.
TARGET, MEASURED = 0.97, 256
#: Columns of a block at least, blocks at most, and the significance of abandoning (larger: safer and slower).
BLOCK, MAX_BLOCKS, SIGNIFICANCE = 16, 32, 2.1
#: Pairs of a query and a candidate, and numbers, that a task has in memory at a time.
PAIRS, NUMBERS = 1 << 18, 1 << 22
#: Entries from this on count as not finite: their squares leave a double's range.
LIMIT = 1e150


def usable(vec: Column) -> Column:
    """Neither null nor all zero, and without null or non-finite entries."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of a and those of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


@dataclass
class Coarse:
    """What a driver fits to the sample: centroids, a rotation, and how many lists to probe."""

    centroids: np.ndarray
    rotation: np.ndarray
    cuts: list[int]
    probes: int

    def order(self, vectors: np.ndarray, many: int) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        out = []
        for at in range(0, len(vectors), 2048):
            far = (self.centroids**2).sum(1)[None, :] - 2 * (vectors[at : at + 2048] @ self.centroids.T)
            out.append(np.argsort(far, axis=1, kind="stable")[:, :many])
        return np.concatenate(out).astype(np.int32)

    def blocks(self, vectors: np.ndarray) -> list[np.ndarray]:
        turned = (vectors @ self.rotation).astype(np.float32)
        return [turned[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])]


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's iterations from random rows of the sample; a centroid that nothing is near to starts again at a far row."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own, far = np.empty(len(sample), np.int64), np.empty(len(sample))
        for at in range(0, len(sample), 2048):
            d = _squares(sample[at : at + 2048], centroids)
            own[at : at + 2048], far[at : at + 2048] = d.argmin(1), d.min(1)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = sample[np.argsort(-far)[: len(empty)]]
    return centroids


def fitted(sample: np.ndarray, rows: int, k: int, seed: int = 5) -> Coarse:
    """Centroids of the sample, and the number of lists that hold TARGET of the true neighbours within the sample.

    In the whole table neighbours are nearer than in a sample of it, so that they are found more often.
    """
    rng, d = np.random.default_rng(seed), sample.shape[1]
    lists = int(np.clip(round(rows**0.5), LISTS[0], min(LISTS[1], max(1, len(sample) // 4))))
    size = max(BLOCK, -(-d // MAX_BLOCKS))
    cuts = [*range(0, d, size), d]
    coarse = Coarse(centroids_of(sample, lists, seed=seed), np.linalg.qr(rng.standard_normal((d, d)))[0], cuts, lists)
    asked = rng.choice(len(sample), min(MEASURED, len(sample)), replace=False)
    of, ranks = coarse.order(sample, 1)[:, 0], []
    for q in asked:
        far = ((sample - sample[q]) ** 2).sum(1)
        far[q] = np.inf
        place = np.empty(lists, np.int64)
        place[coarse.order(sample[q : q + 1], lists)[0]] = np.arange(lists)
        near = np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]
        ranks.append(place[of[near]])
    ranks = np.sort(np.concatenate(ranks))
    coarse.probes = int(ranks[int(np.ceil(TARGET * len(ranks))) - 1]) + 1 if len(ranks) else lists
    return coarse


class Cell:
    """The candidates of a cell: ids, original vectors, and their rotated blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], k: int):
        self.ids, self.vectors, self.blocks, self.k = ids, vectors, [b.astype(np.float64) for b in blocks], k
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.different = len(np.unique(ids)) == len(ids)

    def best(self, ids: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, places of the candidates and exact distances: of each query's candidates within its
        bound (infinite: none known) the k nearest, ties to smaller ids, an id once."""
        step, found = max(1, PAIRS // len(self.ids)), []
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            q, c, far = self._best(ids[part], vectors[part], [b[part].astype(np.float64) for b in blocks], bounds[part])
            found.append((q + at, c, far))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _best(self, ids, vectors, blocks, bounds):
        d, seen = self.vectors.shape[1], blocks[0].shape[1]
        error = 2.0**-22 * (np.sqrt((vectors * vectors).sum(1)).max(initial=0) + self.norms.max(initial=0))  # of blocks in single precision

        def limit(s: int) -> np.ndarray:
            """Partial squares beyond which the hypothesis that a candidate is within the bound is given up."""
            return (bounds * np.sqrt(s / d) * (1 if s == d else 1 + SIGNIFICANCE / np.sqrt(s)) + error) ** 2

        partial = _squares(blocks[0], self.blocks[0])
        q, c = np.nonzero((partial <= limit(seen)[:, None]) & (ids[:, None] != self.ids[None, :]))
        partial = partial[q, c]
        for own, other in zip(blocks[1:], self.blocks[1:]):
            seen += own.shape[1]
            for at in range(0, len(q), NUMBERS // own.shape[1]):
                part = slice(at, at + NUMBERS // own.shape[1])
                partial[part] += ((own[q[part]] - other[c[part]]) ** 2).sum(1)
            alive = partial <= limit(seen)[q]
            q, c, partial = q[alive], c[alive], partial[alive]
        if self.different:  # only what may be among the k is measured
            order = np.lexsort((partial, q))
            q, c, partial = q[order], c[order], np.sqrt(partial[order])
            first = np.searchsorted(q, np.arange(len(ids)))
            last = np.searchsorted(q, np.arange(len(ids)), "right")
            kth = np.where(last - first > self.k, partial[np.minimum(first + self.k - 1, max(0, len(q) - 1))] if len(q) else np.inf, np.inf)
            alive = partial <= kth[q] + 2 * error
            q, c = q[alive], c[alive]
        far, step = np.empty(len(q)), max(1, NUMBERS // d)
        for at in range(0, len(q), step):
            far[at : at + step] = np.sqrt(((vectors[q[at : at + step]] - self.vectors[c[at : at + step]]) ** 2).sum(1))
        order = np.lexsort((far, self.ids[c], q))
        q, c, far = q[order], c[order], far[order]
        if not self.different:
            new = np.r_[True, (q[1:] != q[:-1]) | (self.ids[c[1:]] != self.ids[c[:-1]])][: len(q)]
            q, c, far = q[new], c[new], far[new]
        order = np.lexsort((self.ids[c], far, q))
        q, c, far = q[order], c[order], far[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[top], c[top], far[top]


def _scanned(cells: DataFrame, asked: DataFrame, n_blocks: int, tasks: int, k: int, id_type: str) -> DataFrame:
    """Rows query, id and score: for each query the k nearest within each cell that it asks.

    cells has cell, id, vec and the blocks, asked has them and bound. A cell's candidates come to a task before its queries.
    """
    names = [f"b{j}" for j in range(n_blocks)]
    both = cells.select("cell", F.lit(False).alias("asks"), "id", "vec", *names, F.lit(None).cast("double").alias("bound")).unionByName(
        asked.select("cell", F.lit(True).alias("asks"), "id", "vec", *names, "bound")
    )
    matrices = lambda batch: (_matrix(batch.column(3)), [_matrix(batch.column(4 + j)) for j in range(n_blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, [], None
        for batch in batches:
            cell, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if cell[a] != current:
                    current, held, ready = cell[a], [], None
                own = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(own)
                elif held:
                    if ready is None:
                        parts = [(x.column(2).to_numpy(zero_copy_only=False), *matrices(x)) for x in held]
                        ready = Cell(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [np.concatenate(x) for x in zip(*(p[2] for p in parts))], k)
                        held = [None]
                    ids = own.column(2).to_numpy(zero_copy_only=False)
                    bounds = own.column(4 + n_blocks).to_numpy(zero_copy_only=False)
                    q, c, far = ready.best(ids, *matrices(own), np.where(np.isnan(bounds), np.inf, bounds))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ready.ids[c]), pa.array(far)], ["query", "id", "score"])

    schema = f"query {id_type}, id {id_type}, score double"
    return both.repartition(tasks, "cell").sortWithinPartitions("cell", "asks").mapInArrow(run, schema)


def nearest(df: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """The k nearest rows found, by Euclidean distance, of every row for which query holds: query_id, rank, vec_id, score.

    Nearest first, ties to smaller ids; all candidates where there are fewer than k. score is measured on the original
    vectors. Rows take no part whose id is null or whose vector is null, all zero, of another length than the commonest (of
    ties, the longest), or holds null, non-finite or entries of 1e150 and more. Repeated rows count once. Rows of one id
    with different vectors are candidates and queries alike: an id is listed once, with its nearest vector, and never for
    itself. An empty table gives no rows.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("vec"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    d, n = sizes.d, sizes["count"]
    rows = rows.where(F.size("vec") == d)
    wanted = int(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * d))))
    some = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 40)) < int(min(1, 1.2 * wanted / n) * (1 << 40))) if n > wanted else rows
    sample = some.select("vec").limit(2 * wanted).toArrow()
    coarse = fitted(np.concatenate([_matrix(c) for c in sample.column(0).chunks if len(c)]) if len(sample) else np.zeros((1, d)), n, k)
    n_blocks = len(coarse.cuts) - 1
    names = [f"b{j}" for j in range(n_blocks)]
    arrow = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(1))
                blocks = [pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, b.shape[1], dtype=np.int32)), pa.array(b.ravel())) for b in coarse.blocks(vectors)]
                yield pa.RecordBatch.from_arrays([pa.array(coarse.order(vectors, 1)[:, 0]), batch.column(0), batch.column(1).cast(arrow), batch.column(2), *blocks], ["list", "id", "vec", "asks", *names])

    once = rows.groupBy("id", "vec").agg(F.max("asks").alias("asks"))
    index = staged(once.mapInArrow(listed, f"list int, id {id_type}, vec {kind}, asks boolean, " + ", ".join(f"{b} array<float>" for b in names)), "index")
    per_cell = int(np.clip(n // CELL_PART, *CELL_ROWS))
    held = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # a row for each list
    cells, first = [], 0
    for k_list, count in sorted(held.items()):
        cells.append((k_list, first, -(-count // per_cell)))
        first += cells[-1][2]
    at = F.broadcast(spark.createDataFrame(cells, "list int, first int, cells int"))
    tasks = int(np.clip(first // 8, int(spark.conf.get("spark.sql.shuffle.partitions")), 20_000))
    dealt = index.join(at, "list").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("cells")).cast("int"))

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(0, batch.num_rows, 64):
                own = batch.slice(at_row, 64)
                order = coarse.order(_matrix(own.column(1)), coarse.probes)
                of = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
                place = np.tile(np.arange(order.shape[1], dtype=np.int32), len(order))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel()), pa.array(place), *(c.take(of) for c in own.columns)], ["list", "place", *own.schema.names])

    def probes(asked: DataFrame, where: Column) -> DataFrame:
        """A row for each query, with its bound, and each cell of the lists that it probes."""
        schema = f"list int, place int, id {id_type}, vec {kind}, " + ", ".join(f"{b} array<float>" for b in names) + ", bound double"
        return asked.select("id", "vec", *names, "bound").mapInArrow(probing, schema).where(where).join(at, "list").withColumn(
            "cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("cells") - 1))
        )

    asked = index.where("asks")
    near = staged(_scanned(dealt, probes(asked.withColumn("bound", F.lit(None).cast("double")), F.col("place") == 0), n_blocks, tasks, k, id_type), "near")
    by_score = Window.partitionBy("query").orderBy("score", "id")
    best = near.groupBy("query", "id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    bound = best.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") == k, F.max("score")).alias("bound"))
    rest = _scanned(dealt, probes(asked.join(bound, "id", "left"), F.col("place") > 0), n_blocks, tasks, k, id_type)
    found = near.unionByName(rest).groupBy("query", "id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
