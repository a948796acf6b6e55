"""From raw documents to packed sequences: the stages in order, each over all that its predecessor kept.

In every stage null texts are empty texts, null ids stay null, repeated rows are taken as they come (near-duplicates keep
one of those with the same id), and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import decontaminate, near_duplicates, packing, secrets, toxicity
from driftwatch.llm.common import adopt, delete, new_folder, staging, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches 0.7, by models of the labels' documents among docs."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of SimHash links."""
    return near_duplicates.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of the benchmark occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars of the text as it is then."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1,024 tokens."""
    return packing.packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each one's result is written to the shared folder and read again.

    What a stage staged, and the result that it read, are deleted once its own result is written. The last stage's folders
    stay, as the result reads them; a caller that runs this inside common.staging() deletes them when it has been used.
    """
    docs, behind = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with staging() as own:
            docs = stage(spark, docs, sf_dir)
            folder = new_folder(spark, f"pipeline-{k}")
            docs.write.parquet(folder)
            docs = spark.read.schema(docs.schema).parquet(folder)
        delete(spark, [*behind, *(f for f in own if f != folder)])
        behind = [folder]
    adopt(behind)
    return STAGES[-1][1](spark, docs, sf_dir)
