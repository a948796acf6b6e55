"""What the operators of this subpackage share: reading tables and staging intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: the space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Only a local session may go without it; it then gets a temporary folder for its lifetime.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("driftwatch.shared.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("driftwatch.shared.dir", folder)
    return folder.rstrip("/")


#: The folders made by the innermost staging() of this thread or task; None outside of any.
_owned: ContextVar[list[str] | None] = ContextVar("staged folders", default=None)


@contextmanager
def staging() -> Iterator[list[str]]:
    """Gives the list of the folders that operators make inside it, for delete. Each thread has a list of its own, so that
    runs side by side never see each other's folders. Outside of it folders are nobody's, and stay."""
    token = _owned.set([])
    try:
        yield _owned.get()
    finally:
        _owned.reset(token)


def adopt(folders: Iterable[str]) -> None:
    """Add folders that an inner staging() left to the list of this one, if there is one."""
    if _owned.get() is not None:
        _owned.get().extend(folders)


def new_folder(spark: SparkSession, what: str) -> str:
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    adopt([folder])
    return folder


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete staged folders. Results that read them must have been written before."""
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a short lineage that survives lost executors."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that one Arrow batch brings to a Python worker, for the session.

    Its bytes are bounded by spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set: a longer text comes alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def held_out(id_col: str, parts: int, part: int):
    """crc32 of the id as text, modulo parts, is part. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


#: Rows of two numbers that may be broadcast: some 100 MB at most.
SMALL_ROWS = 4_000_000


def joined_by_id(docs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """docs with the columns of known, rows of a number or two by id. Texts are only shuffled when known is too long to broadcast."""
    few = known.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return docs.join(F.broadcast(known) if few else known, key)


#: For beside_texts: fewest chunks into which texts are dealt, and about how many bytes of text a chunk has beyond that.
CHUNKS, CHUNK_BYTES = 64, 32 << 20
#: Pairs of chunk and key that a task gathers before it hands them on.
GATHERED = 1_000_000


def beside_texts(
    docs: DataFrame, id_col: str, text_col: str, keys_of: Callable[[list[str | None]], Any], key_type: str, look_up: Callable[[DataFrame], DataFrame],
    value: str, value_type: str, prepare: Callable[[dict], Any], finish: Callable[[list[str | None], Any], list], added: str,
) -> DataFrame:
    """docs with columns that depend on the texts and on values looked up by key, for tables too long to broadcast.

    Texts are dealt into chunks by hash. Each chunk's different keys are looked up by a join: look_up takes (chunk, key)
    and returns it with value. They come to the task that has the chunk before its texts do; there prepare makes of them
    what finish needs beside the texts. A task holds the keys of one chunk, however long the table is.
    """
    text = F.col(text_col).cast("string")
    chunks = int(max(CHUNKS, (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // CHUNK_BYTES))
    dealt = docs.select(F.pmod(F.xxhash64(id_col, text), F.lit(chunks)).alias("chunk"), text.alias("text"), F.struct("*").alias("row"))
    names, at, made_names = docs.columns, docs.columns.index(text_col), [part.split()[0].strip("`") for part in added.split(", ")]
    arrow = {"string": pa.string(), "bigint": pa.int64()}[key_type]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, set] = {}

        def gathered() -> pa.RecordBatch:
            of = np.repeat(np.fromiter(keys, np.int64, len(keys)), [len(x) for x in keys.values()])
            return pa.RecordBatch.from_arrays([pa.array(of), pa.array([x for own in keys.values() for x in own], arrow)], ["chunk", "key"])

        for batch in batches:
            chunk, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for c in np.unique(chunk).tolist():
                keys.setdefault(c, set()).update(keys_of([texts[k] for k in np.flatnonzero(chunk == c)]))
            if sum(map(len, keys.values())) > GATHERED:
                yield gathered()
                keys.clear()
        if keys:
            yield gathered()

    by_chunk = staged(dealt.select("chunk", "text").mapInArrow(gather, f"chunk bigint, key {key_type}").distinct(), "keys")
    none = lambda kind: F.lit(None).cast(kind)
    both = look_up(by_chunk).select("chunk", F.lit(False).alias("is_text"), "key", F.col(value).alias("value"), none(dealt.schema["row"].dataType).alias("row")).unionByName(
        dealt.select("chunk", F.lit(True).alias("is_text"), none(key_type).alias("key"), none(value_type).alias("value"), "row")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, ready = None, {}, None
        for batch in batches:
            chunk, is_text = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (is_text[1:] != is_text[:-1])) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if chunk[a] != current:
                    current, known, ready = chunk[a], {}, None
                own = batch.slice(a, b - a)
                if is_text[a]:
                    if ready is None:
                        ready = prepare(known)
                    columns = own.column(4).flatten()
                    yield pa.RecordBatch.from_arrays([*columns, *finish(columns[at].to_pylist(), ready)], [*names, *made_names])
                else:
                    known.update(zip(own.column(2).to_pylist(), own.column(3).to_pylist()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added])
    return both.repartition(chunks, "chunk").sortWithinPartitions("chunk", "is_text").mapInArrow(run, schema)
