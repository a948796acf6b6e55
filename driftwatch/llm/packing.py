"""Best-fit packing with certified bin counts: partitions that may not be optimal exchange pieces and are packed again."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import small_batches, staged
from driftwatch.llm.tokens import END_ID, encoder

#: Tokens of a sequence; pieces that a partition packs at once.
CAPACITY, GROUP = 1024, 5_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each row of docs as ids and their end mark, cut into pieces: doc_id, piece, start, length, ids_crc32.

    A row of more than capacity ids is cut so that all pieces but the first are full. A null text is empty: the end mark alone.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                first = len(ids) % capacity or capacity
                for p, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if p else 0
                    row.append(k)
                    out.append((p, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            piece, start, length, crc = (list(x) for x in zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def least_bins(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound on the bins that items take."""
    return least_bins_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def least_bins_of(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound from the number of items of each length: the best of the dual feasible functions that round up what
    exceeds capacity - t and leave out what is less than t."""
    total = counts * np.arange(capacity + 1)
    below = np.concatenate([[0], np.cumsum(counts)])  # below[x]: items shorter than x
    weight = np.concatenate([[0], np.cumsum(total)])
    best = 0
    for t in range(capacity // 2 + 1):
        big = below[-1] - below[capacity - t + 1]
        middle = weight[capacity - t + 1] - weight[t]
        best = max(best, int(big + -(-middle // capacity)))
    half = int(below[-1] - below[capacity // 2 + 1])
    return max(best, half)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms: list[int] = []  # rooms that some bin has, in order
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_right(rooms, n - 1)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - n:
            if not open_bins[left]:
                insort(rooms, left)
            open_bins[left].append(b)
    return bins, offsets


def _packed(items: DataFrame, round_no: int, capacity: int, last: bool) -> DataFrame:
    """items (grp, seed, length) with bin, offset, and again: whether the bin is given up for another round.

    A group whose bins are as few as its bound is done. Else it gives up its emptiest bins: a sixteenth of them, and
    four for each bin above the bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            lengths = table.column("length").to_numpy()
            bins, offsets = best_fit(lengths, capacity)
            made = int(bins.max()) + 1
            gap = made - least_bins(lengths, capacity)
            again = np.zeros(made, bool)
            if gap and not last:
                fill = np.bincount(bins, lengths, made)
                again[np.argsort(fill, kind="stable")[: 4 + 4 * gap + made // 16]] = True
            grp = table.column("grp").to_numpy()[0]
            label = ((round_no << 56) | (int(grp) << 24)) + bins  # a group has fewer than 2**24 bins, a round fewer than 2**32 groups
            return pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("row", "length")] + [pa.array(label), pa.array(offsets), pa.array(again[bins]), pa.array(np.full(len(bins), gap == 0))], ["row", "length", "sequence_id", "offset", "again", "certified"])

        for batch in batches:  # sorted by group
            grp = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if held and b > a and held[-1].column(0)[0].as_py() != part.column(0)[0].as_py():
                    yield solve(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(part)
        if held:
            yield solve(pa.Table.from_batches(held))

    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.repartition(parts, "grp").sortWithinPartitions("grp", "row")
    return dealt.select("grp", "row", "length").mapInArrow(run, "row bigint, length bigint, sequence_id bigint, offset bigint, again boolean, certified boolean")


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """cut (with a column length) with sequence_id and offset: no sequence over capacity, no gap in it; and certified:
    whether a bound shows that the piece's group has as few sequences as it can.

    Full pieces are sequences of their own. The rest is dealt at random to groups of about ``group`` pieces, each packed
    by best-fit decreasing. A dual feasible function bounds each group's bins from below; where the bound isn't met,
    the group gives up its emptiest bins, whose pieces are dealt anew to fewer groups and packed again, until all groups
    are certified or a single group is left, which keeps what it gets. Groups are bounded, so a task's memory is,
    whatever the number of rows.
    """
    numbered = staged(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = numbered.where(F.col("length") >= capacity).select("_row", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = numbered.where(F.col("length") < capacity).select(F.col("_row").alias("row"), "length")
    done, k, before, left = None, 0, None, rest.count()
    while done is None or left:
        k += 1
        groups = max(1, round(left / group))
        # a round in which all is given up again would be followed by others like it
        last = k > 1 and (groups == 1 or left == before)
        seed = F.pmod(F.xxhash64("row", F.lit(k)), F.lit(groups)).cast("long")
        got = staged(_packed(rest.withColumn("grp", seed), k, capacity, last), "packed")
        kept = got.where(~F.col("again")).select(F.col("row").alias("_row"), "sequence_id", "offset", "certified")
        done = kept if done is None else done.unionByName(kept)
        rest = got.where("again").select("row", "length")
        before, left = left, 0 if last else rest.count()
    return numbered.join(full.unionByName(done), "_row").drop("_row")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences made, a lower bound on them for all pieces together, the gap between the two, and the pieces in
    groups that are certified. The bound takes a histogram of lengths, of at most capacity rows."""
    counts = packed.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    lengths, n = counts.column("length").to_numpy(), counts.column("n").to_numpy()
    bound = least_bins_of(np.bincount(lengths, n, capacity + 1).astype(np.int64), capacity)
    one = packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.count(F.when(F.col("certified"), 1)).alias("certified_pieces"))
    return one.select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"), "certified_pieces")


def packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified: where each piece of each row of docs went.

    Repeated rows are packed as often as they come, a null id stays null, a null or empty text is one piece of one id,
    other columns are ignored. An empty table gives an empty result.
    """
    return pack(pieces(docs, id_col, text_col, tokenizer)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
