"""Ticks, quotes, alerts, labels and returns derived from the tables ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.operators.windows import forward_fill, log_returns

ASSETS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per event with a positive value: symbol, ts_ns, seq, price, size."""
    ts_ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    size = (1 + F.col("user_id") % 50).cast("double")
    rows = table(spark, sf_dir, "events").where("value > 0")
    return rows.select(F.col("event_type").alias("symbol"), ts_ns.alias("ts_ns"), F.col("event_id").alias("seq"), F.col("value").alias("price"), size.alias("size"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top of book around each trade; every 97th is crossed."""
    half = F.col("price") * (1 + F.col("seq") % 7) / 10000
    crossed = F.col("seq") % 97 == 0
    sized = lambda by: (1 + (F.col("seq") * by) % 100).cast("double")
    return ticks(spark, sf_dir).select(
        "symbol", "ts_ns", "seq",
        F.when(crossed, F.col("price") + half).otherwise(F.col("price") - half).alias("bid"),
        F.when(crossed, F.col("price") - half).otherwise(F.col("price") + half).alias("ask"),
        sized(7919).alias("bid_size"), sized(104729).alias("ask_size"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick whose price is low or high, but not extreme, as an alert. The score is its distance from 50 in tens; its
    sign and size give the kind."""
    score = (F.col("price") - 50) / 10
    kind = F.when(score >= 8, "burst").when(score > 0, "robust_z").otherwise("cusum")
    return ticks(spark, sf_dir).where("price between 1 and 20 or (price >= 80 and price < 200)").select("ts_ns", "symbol", "seq", kind.alias("kind"), "price", score.alias("score"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick of an extreme price as a labelled event: the highest are points in time, the lowest open quiet windows of two hours."""
    quiet = F.col("price") < 1
    kind = F.when(quiet, "calm").when(F.col("price") >= 250, "outage").when(F.col("price") >= 220, "halt").otherwise("news")
    return ticks(spark, sf_dir).where("price < 1 or price >= 200").select(
        F.col("seq").alias("event_no"), "ts_ns", "symbol", kind.alias("event_type"),
        F.when(quiet, "quiet").otherwise("positive").alias("polarity"), F.when(quiet, 7200.0).otherwise(0.0).alias("duration_sec"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean price of ASSETS assets, one row a day and asset: d, asset, px."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_shipdate").cast("date").alias("d"), (F.col("l_suppkey") % ASSETS).cast("int").alias("asset")).agg(F.avg("l_extendedprice").alias("px"))


def wide_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of each asset, p0 to p7; gaps of at most two days are filled, other incomplete days dropped."""
    names = [f"p{k}" for k in range(ASSETS)]
    wide = prices(spark, sf_dir).groupBy("d").pivot("asset", list(range(ASSETS))).agg(F.first("px"))
    wide = wide.toDF("d", *names)
    return forward_fill(wide, "d", names, 2).dropna(subset=names)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns of wide_prices: d, t (1, 2, ...), r0 to r7."""
    return log_returns(wide_prices(spark, sf_dir), "d", [f"p{k}" for k in range(ASSETS)], [f"r{k}" for k in range(ASSETS)])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades and quotes as one stream; at one seq the trade comes first."""
    none = lambda *names: [F.lit(None).cast("double").alias(n) for n in names]
    t = ticks(spark, sf_dir).select("symbol", "ts_ns", (F.col("seq") * 2).alias("seq"), F.lit("t").alias("etype"), "price", "size", *none("bid", "ask", "bid_size", "ask_size"))
    q = quotes(spark, sf_dir).select("symbol", "ts_ns", (F.col("seq") * 2 + 1).alias("seq"), F.lit("q").alias("etype"), *none("price", "size"), "bid", "ask", "bid_size", "ask_size")
    return t.unionByName(q)


def ordered(by: str = "symbol"):
    """A window over a symbol's rows in the order in which detectors see them."""
    return Window.partitionBy(by).orderBy("ts_ns", "seq")
