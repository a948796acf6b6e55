"""Quality rules by host: shrunken failure rates joined back to documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import WHITE, staged

SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 5
#: What fails a document, by rule: few words or much repetition (the base rules), many symbols, many repeated lines.
RULES = {
    "few_words": "n_words < 10",
    "repetition": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
#: A host is rejected if its shrunken rate of failures by one rule exceeds this.
MAX_RATE = 0.5
#: How strong a prior is at least and at most, in documents.
STRENGTHS = 1.0, 1000.0


def _windows(words: str) -> Column:
    """A hash of each window of WINDOW words, in order."""
    at = lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(WINDOW)))
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: counts over its whole text, which rules it fails (fails_...), and whether one of the base rules.

    A null text has no words. Windows are compared within a document by 64-bit hashes: the odds that a text of
    20,000 words has an accidental match are below 1e-10.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "").alias("words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"),
    )
    second = first.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows("words").alias("h"),
    )
    ordered = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    third = second.withColumn("z", F.when(F.size("h") > F.size(F.array_distinct("h")), ordered))
    near = lambda k: F.coalesce(F.get(F.col("z"), k)["h"], F.lit(None).cast("bigint"))
    marked = F.transform("z", lambda e, k: F.when((near(k - 1) == e["h"]) | (near(k + 1) == e["h"]), e["at"]))
    fourth = third.withColumn("starts", F.array_sort(F.filter(marked, lambda x: x.isNotNull())))
    # a repeated window adds the words up to the next one's start, WINDOW at most
    adds = F.transform("starts", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - x, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(adds, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")
    out = fourth.select("doc_id", "host", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))
    return out.withColumns({f"fails_{rule}": F.expr(cond) for rule, cond in RULES.items()}).withColumn("base_failed", F.col("fails_few_words") | F.col("fails_repetition"))


def host_verdicts(features: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: its documents, for each rule its failure rate (rate_...) shrunken towards all hosts' by a beta
    prior, the worst rule and its rate, and whether that exceeds max_rate.

    A rule's prior is fitted to all hosts by moments: its mean is the share of all documents that fail, and it is as
    strong as the spread of hosts' rates allows beyond what sampling alone adds. Without such spread, or with one host,
    it is as strong as 1,000 documents. Documents without a host belong to none.
    """
    fails = lambda rule: F.sum(F.col(f"fails_{rule}").cast("long")).alias(f"k_{rule}")
    hosts = features.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("host_docs"), *map(fails, RULES))
    mean = lambda rule: F.least(F.greatest(F.sum(f"k_{rule}") / F.sum("host_docs"), F.lit(1e-6)), F.lit(1 - 1e-6)).alias(f"m_{rule}")
    spread = lambda rule: F.var_samp(F.col(f"k_{rule}") / F.col("host_docs")).alias(f"v_{rule}")
    moments = hosts.agg(F.avg(1 / F.col("host_docs")).alias("inv"), *map(mean, RULES), *map(spread, RULES))
    x = hosts.join(F.broadcast(moments), F.lit(True))  # one row

    def rate(rule: str) -> Column:
        m, v, k = F.col(f"m_{rule}"), F.col(f"v_{rule}"), F.col(f"k_{rule}")
        beyond = v - m * (1 - m) * F.col("inv")
        low, high = map(F.lit, STRENGTHS)
        strength = F.when(beyond > 0, F.least(F.greatest(m * (1 - m) / beyond - 1, low), high)).otherwise(high)
        return (k + m * strength) / (F.col("host_docs") + strength)

    rated = x.select("host", "host_docs", *(rate(rule).alias(f"rate_{rule}") for rule in RULES))
    worst = F.array_max(F.array(*(F.struct(F.round(f"rate_{rule}", 9).alias("rate"), F.lit(rule).alias("rule")) for rule in RULES)))
    return rated.withColumn("w", worst).select("host", "host_docs", *(f"rate_{rule}" for rule in RULES), F.col("w.rule").alias("host_rule"), F.col("w.rate").alias("host_rate"), (F.col("w.rate") > max_rate).alias("host_rejected"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Features and verdict of each row of docs; other columns of docs are ignored, so their names can't clash.

    Rows are kept apart: a repeated row gives a repeated result. Null text: no words, so it fails the base rules.
    Null host: judged by the base rules alone. Null id: stays null. An empty table gives an empty result.
    The features are staged once, as both the host statistics and the result need them; they are a few numbers a
    document. The join is on a key that may be hot, between plain shuffles, which adaptive execution splits.
    """
    features = staged(document_features(docs, id_col, text_col, host_col), "quality-features")
    joined = features.join(host_verdicts(features, max_rate), "host", "left")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"), "host_rule", "host_rate",
    )
