"""Token counts: the exact histogram of encoded lengths, whose suffix sums answer for every context limit."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import small_batches, staged

#: The vocabulary, by its name among the public tokenizers or as a path; the id that ends a document; ids of special marks.
VOCABULARY, END_ID, SPECIAL = "byte_bpe_50k.json", 2, {"<|endoftext|>": 50256}
#: Lengths of a block of the histogram, so that suffix sums need no sort of all lengths in one task.
BLOCK = 4096


#: Characters of a text that are encoded at a time, and up to which the ranks' library takes any text.
PART, PART_MAX = 1 << 15, 1 << 16
#: A word may be cut from the next before a single space or line feed: no id of the vocabulary reaches across.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


def _parts(text: str) -> Iterator[str]:
    """text in parts of some PART characters, longer where there is no place to cut."""
    at = 0
    while len(text) - at > PART_MAX:
        m = _CUT.search(text, at + PART)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None) -> Callable[[str], np.ndarray]:
    """What turns a text into ids as the vocabulary's file does without marks of its own.

    Of the file's two forms with the same ids, the ranks are several times as fast. They can't take long runs of white
    space, so a part of more than PART_MAX characters goes by the file itself, as do a text with a special mark and a
    vocabulary without ranks.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    name = vocabulary or VOCABULARY
    path = name if os.path.exists(name) else public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    if not os.path.exists(ranks_path):
        return slow
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        marked = any(mark in text for mark in SPECIAL)
        ids = [slow(part) if marked or len(part) > PART_MAX else np.array(fast.encode_ordinary(part), np.uint32) for part in _parts(text)]
        return ids[0] if len(ids) == 1 else np.concatenate(ids)

    return encode


def encoded_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """length of each row of docs: its ids, without an end mark. Null and empty texts have none."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            lengths = np.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], np.int64)
            value, n = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["length", "n_docs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length bigint, n_docs bigint")


def histogram(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """length and n_docs, one row for each length that occurs."""
    return encoded_lengths(docs, text_col, tokenizer).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """A histogram with what a context limit of each length gives.

    docs_over and tokens_over: of the longer documents. tokens_kept: of all documents, each cut at the limit.
    docs_upto: documents that fit whole, so quantile q is the least length with docs_upto >= q * n. docs_total,
    tokens_total: of all. Sums run within blocks of BLOCK lengths, and over the blocks' few totals.
    """
    own = lengths.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = blocks.select("block", zero(F.sum("bd").over(after)).alias("ad"), zero(F.sum("bt").over(after)).alias("at"), F.sum("bd").over(whole).alias("docs_total"), F.sum("bt").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(blocks, "block").select(
        "length", "n_docs", "docs_total", "tokens_total",
        (F.col("ad") + zero(F.sum("n_docs").over(inside))).alias("docs_over"),
        (F.col("at") + zero(F.sum("tokens").over(inside))).alias("tokens_over"),
    )
    kept = F.col("tokens_total") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    return out.withColumn("docs_upto", F.col("docs_total") - F.col("docs_over")).withColumn("tokens_kept", kept)


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: docs that fit, docs cut, and tokens kept of all documents cut at the limit."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    n = F.col("n_docs")

    def at(limit: int):
        fits = F.col("length") <= limit
        return F.struct(
            F.lit(limit).cast("long").alias("limit"), total(F.when(fits, n)).alias("docs_fit"), total(F.when(~fits, n)).alias("docs_cut"),
            total(F.least("length", F.lit(limit).cast("long")) * n).alias("tokens_kept"),
        )

    return sums.agg(F.array(*(at(int(x)) for x in limits)).alias("x")).select(F.inline("x"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that this share of the documents doesn't exceed; null for an empty histogram."""
    at = lambda q: F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("docs_upto") >= F.lit(q) * F.col("docs_total"), F.col("length"))).alias("length"))
    return sums.agg(F.array(*(at(float(q)) for q in shares)).alias("x")).select(F.inline("x"))


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The whole histogram of docs with its suffix sums. Null and empty texts count with length zero, repeated rows as
    often as they come, other columns are ignored. An empty table gives an empty result.

    The histogram is staged, as the sums within blocks and those over blocks both read it: texts are encoded once.
    """
    return suffix_sums(staged(histogram(docs, text_col, tokenizer), "length-counts"))
