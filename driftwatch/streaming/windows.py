"""Windows and joins over streams by event time: the same functions over tables, where they need no watermark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwatch.operators.evaluate import windows_of

NS = 1_000_000_000


def event_time(ts_ns: str = "ts_ns") -> Column:
    """The microsecond in which a time lies, for watermarks and windows; exact times stay in ts_ns."""
    return F.timestamp_micros(F.expr(f"{ts_ns} div 1000"))


def timed(rows: DataFrame, delay_sec: float, name: str = "event_time", ts_ns: str = "ts_ns") -> DataFrame:
    """rows with their time; of a stream, with a watermark delay_sec behind the latest."""
    rows = rows.withColumn(name, event_time(ts_ns))
    return rows.withWatermark(name, f"{round(delay_sec * 1000)} milliseconds") if rows.isStreaming else rows


def _totals() -> list[Column]:
    return [F.count("*").alias("n"), F.max(F.abs("score")).alias("most"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")]


def alert_windows(alerts: DataFrame, window_sec: int, slide_sec: int | None = None, delay_sec: float = 0) -> DataFrame:
    """w_ns (a window's start), symbol, kind, n, most (of abs(score)), first_ns, last_ns: tumbling windows, or sliding ones
    every slide_sec. Windows in which nothing lies have no row. A stream gives each once the watermark has passed its end."""
    window = F.window("event_time", f"{window_sec} seconds", f"{slide_sec or window_sec} seconds")
    found = timed(alerts, delay_sec).groupBy(window.alias("w"), "symbol", "kind").agg(*_totals())
    return found.select((F.unix_micros("w.start") * 1000).alias("w_ns"), "symbol", "kind", "n", "most", "first_ns", "last_ns")


def alert_sessions(alerts: DataFrame, gap_sec: int, delay_sec: float = 0) -> DataFrame:
    """symbol, n, most, first_ns, last_ns of each run of a symbol's alerts that are less than gap_sec apart."""
    found = timed(alerts, delay_sec).groupBy(F.session_window("event_time", f"{gap_sec} seconds").alias("w"), "symbol").agg(*_totals())
    return found.select("symbol", "n", "most", "first_ns", "last_ns")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, by the progress that the query remembers."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def alerts_with_events(alerts: DataFrame, events: DataFrame, tolerance_sec: float, longest_sec: float, delay_sec: float = 0, how: str = "inner") -> DataFrame:
    """Each pair of an alert and a labelled event of its symbol whose window it lies in, both sides streams: the pairs of
    interval_join. how left_outer: alerts in no window too, alone, once no event can come that they would lie in.

    An event is kept until the watermark has passed longest_sec, or the tolerance, after it; an alert until it has passed
    the tolerance after it. Of an event's time what lies beyond longest_sec doesn't count.
    """
    most, least = (F.expr(f"interval {math.ceil(x) + 1} seconds") for x in (max(tolerance_sec, longest_sec), tolerance_sec))
    e = windows_of(events, tolerance_sec).withColumn("we_to", F.least("we_to", F.col("ts_ns") + F.lit(int(max(tolerance_sec, longest_sec) * NS))))
    e = timed(e.withColumnRenamed("ts_ns", "event_ts"), delay_sec, "_label_time", "event_ts").withColumnRenamed("symbol", "_symbol")
    a = timed(alerts, delay_sec, "_alert_time")
    near = (F.col("_alert_time") >= F.col("_label_time") - least) & (F.col("_alert_time") <= F.col("_label_time") + most)
    meet = (F.col("symbol") == F.col("_symbol")) & near & F.col("ts_ns").between(F.col("we_from"), F.col("we_to"))
    return a.join(e, meet, how).drop("_symbol", "_alert_time", "_label_time")
