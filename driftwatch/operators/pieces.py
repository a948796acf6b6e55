"""Folds over a hot symbol's rows, cut by time and still exact: what each piece takes over is guessed, then proved.

A detector forgets: from whatever state it starts, after enough rows it stands where any other start would have brought it,
to the last bit. So each piece starts blank some rows early (its lead), all pieces at once, and notes the state in which it
came to its own first row and the one in which it left its last. Where the state that a piece left isn't, bit by bit, the
one in which the next began, the next is run again from the former. Results are those of one run over the whole symbol,
wherever it is cut; a short lead, or values that keep two starts apart, cost a second run of a piece, never a digit.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
#: Rows of a piece; a symbol with fewer than two pieces' rows stays whole. Parts of a piece that are counted to cut evenly.
PIECE_ROWS, PARTS = 1_000_000, 64
#: Rows of a table of symbols or stretches that may be broadcast, some 30 MB; tasks over which pieces are dealt at most.
BROADCAST_ROWS, MAX_TASKS = 500_000, 20_000


class Fold(Protocol):
    """A symbol's state. It can be pickled."""

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> list | None:
        """Columns of the output for the next rows in order, or None."""

    def mark(self) -> bytes:
        """All of the state that can matter to later rows, equal bytes for equal futures."""


#: Makes a symbol's fold. number is the count that start gives for the first row it will see, else 0.
Fresh = Callable[[str, int], Fold]


@dataclass
class Pieces:
    """rows with _piece, their number within the symbol, and _own, false for copies of rows that lead a later piece."""

    rows: DataFrame
    tasks: int


def kept(df: DataFrame) -> DataFrame:
    """df as it is written to the checkpoint folder: executors can go without its being made again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def small(known: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows, which are counted."""
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def cut(rows: DataFrame, piece_rows: int, lead_rows: int) -> Pieces | None:
    """rows in pieces; None if no symbol has rows for two.

    Rows are counted by symbol and short stretches of time, some PARTS to a piece; a stretch stays whole. A piece is led by
    lead_rows rows at least, if there are as many.
    """
    counted = rows.groupBy("symbol").agg(F.count("*").alias("_n"), F.min("ts_ns").alias("_from"), F.max("ts_ns").alias("_to")).persist()
    try:
        most, pieces = counted.agg(F.max("_n"), F.sum(F.ceil(F.col("_n") / piece_rows))).first()
        if (most or 0) < 2 * piece_rows:
            return None
        sizes = kept(counted)
    finally:
        counted.unpersist()
    spans = sizes.select("symbol", "_from", F.expr(f"(_to - _from) div (ceil(_n / {piece_rows}) * {PARTS}) + 1").alias("_width"))
    placed = rows.join(small(spans), "symbol").withColumn("_part", F.expr("(ts_ns - _from) div _width")).drop("_from", "_width")
    before = Window.partitionBy("symbol").orderBy("_part")  # a row a stretch
    counts = placed.groupBy("symbol", "_part").agg(F.count("*").alias("_n")).withColumn("_end", F.sum("_n").over(before))
    piece = F.floor((F.col("_end") - F.col("_n")) / piece_rows)
    last = F.floor((F.col("_end") + lead_rows - 1) / piece_rows)  # pieces from there on begin too late for this stretch to lead them
    goes = kept(counts.select("symbol", "_part", piece.alias("_in"), F.greatest(piece, last).alias("_last")))
    dealt = placed.join(small(goes), ["symbol", "_part"]).withColumn("_piece", F.explode(F.sequence("_in", "_last")))
    tasks = int(min(MAX_TASKS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * pieces)))
    return Pieces(dealt.withColumn("_own", F.col("_piece") == F.col("_in")).drop("_part", "_in", "_last"), tasks)


def _folded(dealt: DataFrame, tasks: int, fresh: Fresh, schema: str, entries: dict[tuple[str, int], bytes]) -> DataFrame:
    """What the folds make of each piece's own rows; and for each piece a row with the marks of the states in which it
    began and ended, and the latter. entries: states from which some pieces begin, in place of their leads."""
    values = [c for c in dealt.columns if c not in ("symbol", "_piece", "_own", "_number")]
    number = F.col("_number") if "_number" in dealt.columns else F.lit(0).cast("bigint")
    ordered = dealt.select("symbol", "_piece", "_own", number.alias("_number"), *values).repartition(tasks, "symbol", "_piece").sortWithinPartitions("symbol", "_piece", "ts_ns", "seq")
    fields = [tuple(f.split()) for f in schema.split(", ")]
    extra = [("_symbol", pa.string()), ("_of", pa.int64()), ("_begin", pa.binary()), ("_end", pa.binary()), ("_state", pa.binary())]
    out_schema = pa.schema([(n, ARROW[t]) for n, t in fields] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, begin = None, None, None

        def left() -> pa.RecordBatch:
            nothing = [pa.nulls(1, ARROW[t]) for _, t in fields]
            end = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in (begin, fold.mark(), pickle.dumps(fold)))]
            return pa.RecordBatch.from_arrays([*nothing, *end], schema=out_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            names, piece, own = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            codes = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]]
            new = (codes[1:] != codes[:-1]) | (piece[1:] != piece[:-1]) | (own[1:] != own[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                here = (names[a], int(piece[a]))
                if here != key:
                    if begin is not None:
                        yield left()
                    given = entries.get(here)
                    fold = pickle.loads(given) if given else fresh(here[0], int(batch.column(3)[a].as_py() or 0))
                    key, begin, led = here, None, given is not None
                if not own[a]:
                    if here not in entries:
                        fold(here[0], [c[a:b] for c in arrays])
                        led = True
                    continue
                if begin is None:
                    begin = fold.mark() if led else b""
                made = fold(here[0], [c[a:b] for c in arrays])
                if made is not None and len(made[0]):
                    size = len(made[0])
                    columns = [c if isinstance(c, pa.Array) else pa.array(c, ARROW[t]) for c, (_, t) in zip(made, fields)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([key[0]] * size), pa.array([key[1]] * size, pa.int64()), *(pa.nulls(size, pa.binary()) for _ in range(3))], schema=out_schema)
        if begin is not None:
            yield left()

    return ordered.mapInArrow(run, f"{schema}, _symbol string, _of bigint, _begin binary, _end binary, _state binary")


def fold_pieces(pieces: Pieces, fresh: Fresh, schema: str) -> DataFrame:
    """What fresh's folds make of each symbol's rows in the order of (ts_ns, seq), dealt into pieces by cut.

    Runs when it is called. As many rounds as it takes until each piece began as the one before it ended: one, where leads
    are long enough, and at most as many as a symbol has pieces.
    """
    dealt, tasks = pieces.rows, pieces.tasks
    done = kept(_folded(dealt, tasks, fresh, schema, {}))
    by_piece = Window.partitionBy("_symbol").orderBy("_of")  # a row a piece
    while True:
        marks = done.where("_end is not null")
        handed = marks.select("_symbol", "_of", "_begin", F.lag("_end").over(by_piece).alias("_left"), F.lag("_state").over(by_piece).alias("_given"))
        wrong = {(r["_symbol"], r["_of"]): bytes(r["_given"]) for r in handed.where("_left is not null and _left <> _begin").select("_symbol", "_of", "_given").collect()}
        if not wrong:
            return done.where("_end is null").drop("_symbol", "_of", "_begin", "_end", "_state")
        keys = F.broadcast(dealt.sparkSession.createDataFrame([*wrong], "_symbol string, _of bigint"))
        again = dealt.where("_own").join(keys, (F.col("symbol") == F.col("_symbol")) & (F.col("_piece") == F.col("_of")), "left_semi")
        done = done.join(keys, ["_symbol", "_of"], "left_anti").unionByName(kept(_folded(again, tasks, fresh, schema, wrong)))
