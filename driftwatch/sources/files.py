"""Files with fixed schemas, generated ticks, and a replay of files as a stream."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalar import rfc3339_ns, text_of
from driftwatch.schemas import ALERT_ROW, CATALOG, TICK

#: Where live feeds are found by name, and what an unknown name gives.
FEEDS = {"iex": "/v2/iex", "sip": "/v2/sip", "crypto": "/v1beta3/crypto/us"}


def feed_path(name: str) -> str:
    return FEEDS.get(name, f"/v2/{name}")


def ticks_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Ticks of a file or folder; of one symbol if it is given."""
    rows = spark.read.schema(TICK).csv(path, header=True)
    return rows.where(F.col("symbol") == symbol) if symbol else rows


def replay(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The folder's files as a stream; the trigger of the query that reads it sets the pace."""
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_per_batch).csv(folder, header=True)


def alerts_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_ROW).csv(path, header=True)


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled events. A row with missing, extra or malformed fields raises an error; a file may lack its last columns.

    Defaults: event_type unknown, description empty, polarity positive, duration 0.
    """
    header = spark.read.text(path).first()
    names = next(csv.reader([header["value"].removeprefix("\ufeff")]), []) if header else []
    known = dict(part.split() for part in CATALOG.split(", "))
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown columns {unknown} in {path}")
    schema = ", ".join(f"{n} {known[n]}" for n in names) or CATALOG
    rows = spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True, enforceSchema=False)
    for name, value in (("event_type", "unknown"), ("description", ""), ("polarity", "positive"), ("duration_sec", 0.0)):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in names else F.lit(value))
    bad = rows.where(~F.col("polarity").isin("positive", "quiet") | F.col("ts_ns").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"malformed row in {path}: {bad[0]}")
    return rows.select(*known)


def synthetic_ticks(spark: SparkSession, symbols: list[str], n: int, anomaly_rate: float = 1e-4, seed: int = 42) -> DataFrame:
    """n ticks dealt to the symbols in turn, each a geometric random walk from 100 with rare jumps of 2 % either way."""
    dt, sigma = 1e-4, 0.5
    step = F.randn(seed) * sigma * dt**0.5 - sigma * sigma / 2 * dt
    jump = F.when(F.rand(seed + 1) < anomaly_rate, F.log(F.when(F.rand(seed + 2) < 0.5, 0.98).otherwise(1.02))).otherwise(0.0)
    rows = spark.range(n).select(F.element_at(F.array(*map(F.lit, symbols)), (F.col("id") % len(symbols) + 1).cast("int")).alias("symbol"), F.col("id").alias("seq"), (F.col("id") * 100_000).alias("ts_ns"), (step + jump).alias("x"))
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("ts_ns", "symbol", (100 * F.exp(F.sum("x").over(w))).alias("price"), "seq")


def messages(lines: DataFrame, start: str | None = None) -> DataFrame:
    """Trades and quotes of live feeds from lines of JSON, each a list of messages; other and malformed messages are skipped.

    seq is a message's place in its list, counted from the line's column start if one is named. A number that is missing or
    malformed is null.
    """
    # as maps, for names that differ in case alone
    first = F.col(start) if start else F.lit(0)
    m = lines.select(first.alias("first"), F.posexplode(F.from_json("value", "array<map<string, string>>")).alias("place", "m"))
    number = lambda key: F.col("m")[key].try_cast("double")
    kept = m.where(F.col("m")["T"].isin("t", "q"))
    names = {"price": "p", "size": "s", "bid": "bp", "ask": "ap", "bid_size": "bs", "ask_size": "as"}
    return kept.select(F.col("m")["S"].alias("symbol"), rfc3339_ns(F.col("m")["t"]).alias("ts_ns"), (F.col("first") + F.col("place")).cast("bigint").alias("seq"), F.col("m")["T"].alias("etype"), *(number(k).alias(n) for n, k in names.items()))


def message_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Trades and quotes from files of such lines as they come into a folder: what a feed's client writes, as a stream for detect_stream."""
    return messages(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of each file, of up to 2 GB, under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_alerts_csv(alerts: DataFrame, path: str) -> None:
    """Alerts as files with a header: prices with six places, scores with four."""
    rows = alerts.select("ts_ns", "symbol", "kind", text_of(F.col("price"), ".6f").alias("price"), text_of(F.col("score"), ".4f").alias("score"))
    rows.write.mode("overwrite").csv(path, header=True)


def write_ticks_csv(ticks: DataFrame, path: str) -> None:
    """Ticks as files that ticks_csv and replay read; a wide table's column goes by wide_to_ticks first."""
    ticks.select("ts_ns", "symbol", text_of(F.col("price"), ".6f").alias("price")).write.mode("overwrite").csv(path, header=True)


def wide_to_ticks(wide: DataFrame, day: str, column: str) -> DataFrame:
    """One column of a daily table as ticks at midnight, nulls left out."""
    return wide.where(F.col(column).isNotNull()).select((F.unix_date(day).cast("bigint") * 86_400_000_000_000).alias("ts_ns"), F.lit(column).alias("symbol"), F.col(column).cast("double").alias("price"))
