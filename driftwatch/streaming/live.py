"""The detectors over a stream, with a symbol's state kept by Structured Streaming, and where their alerts go.

Each micro-batch's events of a symbol are sorted by time before its detectors see them. Events aren't reordered across
batches; put a watermark on the source to drop late ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.scalar import asset_class, narrative, severity
from driftwatch.operators.detect import Step, in_order
from driftwatch.operators.kernels import LIBRARY, Params, Symbol, as_rows
from driftwatch.schemas import ALERT
from driftwatch.sources.files import write_ticks_csv


def detect_stream(events: DataFrame, params: Params = LIBRARY) -> DataFrame:
    """Alerts of a stream of events, by the same states as over tables."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        symbol = pickle.loads(state.get[0]) if state.exists else Symbol(params)
        rows = pd.concat(list(frames)).sort_values(["ts_ns", "seq"], kind="stable")
        ts = rows["ts_ns"].to_numpy(np.int64)
        values = [pd.to_numeric(rows[c]).to_numpy(np.float64) for c in ("price", "size", "bid", "ask", "bid_size", "ask_size")]
        out = as_rows(key[0], ts, rows["seq"].to_numpy(np.int64), symbol.run((rows["etype"] == "q").to_numpy(bool), ts, *values))
        state.update((pickle.dumps(symbol),))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in ALERT.split(", ")]).astype({"ts_ns": "int64", "seq": "int64", "ord": "int32", "price": "float64", "score": "float64"})

    return events.groupBy("symbol").applyInPandasWithState(update, ALERT, "state binary", "append", "NoTimeout")


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Appends a batch's alerts, parted by kind, under a folder of its own, so that a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")

    return write


def alert_history(spark: SparkSession, path: str, symbol: str | None = None, kind: str | None = None, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """What table_sink wrote, latest first; conditions reach the files, kinds their folders."""
    rows = spark.read.parquet(path).drop("batch")
    for column, value in (("symbol", symbol), ("kind", kind)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if since is None else rows.where(F.col("ts_ns") >= since)
    rows = rows if until is None else rows.where(F.col("ts_ns") <= until)
    rows = rows.withColumn("severity", severity()).withColumn("narrative", narrative()).orderBy(F.desc("ts_ns"), F.desc("seq"), F.desc("ord"))
    return rows if limit is None else rows.limit(limit)


def recorder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Records a batch's trades, quotes left out, as files that the replay reads."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_ticks_csv(batch.where("etype = 't' and price is not null"), f"{path}/batch={batch_id}")

    return write


def digests(alerts: DataFrame, window_sec: int = 60, min_score: float = 6.0, cooldown_sec: int = 900) -> DataFrame:
    """One row a window in which something is told: w, n alerts, names (three at most), n_symbols, subject.

    Windows lie on the clock. An alert counts if its abs(score) is min_score at least and its symbol wasn't in a digest
    sent (at its window's end) less than cooldown_sec before. Symbols' windows are told or not in order; the state is a
    symbol's last one.
    """
    size = window_sec * 1_000_000_000
    strong = alerts.where(F.abs("score") >= min_score)

    def fresh(symbol: str) -> Step:
        sent: list[int] = []

        def own(symbol: str, columns: list[np.ndarray]) -> list | None:
            told: list[int] = []
            for ts in columns[0].tolist():
                w = ts // size
                if not sent or w == sent[0] or ts - (sent[0] + 1) * size >= cooldown_sec * 1_000_000_000:
                    sent[:] = [w]
                    told.append(w)
            return [[symbol] * len(told), told]

        return own

    told = in_order(strong.select("symbol", "ts_ns", F.lit(0).cast("bigint").alias("seq")), fresh, "symbol string, w bigint")
    names = F.sort_array(F.collect_set("symbol"))  # as many as there are symbols
    by = told.groupBy("w").agg(F.count("*").alias("n"), names.alias("_names")).withColumn("n_symbols", F.size("_names").cast("bigint"))
    subject = F.when(F.col("n") == 1, F.concat(F.lit("1 alert on "), F.get("_names", F.lit(0)))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" alerts on "), F.col("n_symbols").cast("string"), F.lit(" symbols")))
    return by.select("w", "n", F.concat_ws(", ", F.slice("_names", 1, 3)).alias("names"), "n_symbols", subject.alias("subject"))


#: Alerts of a body at most.
BODY_ALERTS = 10_000


def webhook_bodies(alerts: DataFrame, feed: str, min_score: float = 0.0, source: str = "driftwatch", window_sec: int = 1) -> DataFrame:
    """w, n and the JSON body of the alerts of each window of so many seconds, in order of time, symbol and kind. A window
    of more than BODY_ALERTS alerts has several bodies, of n alerts each."""
    chosen = alerts.where(F.abs("score") >= min_score).withColumn("w", F.floor(F.col("ts_ns") / (window_sec * 1_000_000_000)))
    counts = chosen.groupBy("w").agg(F.ceil(F.count("*") / BODY_ALERTS).alias("_bodies"))
    part = F.pmod(F.xxhash64("ts_ns", "symbol", "kind", "price", "score"), F.col("_bodies"))
    rows = F.sort_array(F.collect_list(F.struct("ts_ns", "symbol", "kind", "price", "score")))
    body = F.struct(F.lit(source).alias("source"), F.lit(feed).alias("feed"), asset_class(F.lit(feed)).alias("asset_class"), rows.alias("alerts"))
    return chosen.join(counts, "w").groupBy("w", part.alias("_part")).agg(F.count("*").alias("n"), F.to_json(body).alias("body")).drop("_part")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks: kept in memory once, delivered to each, dropped by none."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write
