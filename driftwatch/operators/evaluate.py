"""Alerts against labelled events: interval joins, recall, false positives, time to detection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalar import wilson
from driftwatch.operators.models import poisson_intervals
from driftwatch.operators.windows import at_ranks
from driftwatch.sources.files import alerts_csv, catalog_csv, file_sha256

NS, DAY = 1_000_000_000, 86_400


def windows_of(events: DataFrame, tolerance_sec: float) -> DataFrame:
    """we_from and we_to, both inclusive: around a point event the tolerance, else the event's own time without it."""
    t, d = F.lit(int(tolerance_sec * NS)).cast("bigint"), (F.col("duration_sec") * NS).cast("bigint")
    point = F.col("duration_sec") <= 0
    return events.withColumn("we_from", F.when(point, F.col("ts_ns") - t).otherwise(F.col("ts_ns"))).withColumn("we_to", F.when(point, F.col("ts_ns") + t).otherwise(F.col("ts_ns") + d))


def interval_join(alerts: DataFrame, events: DataFrame, tolerance_sec: float, bucket_sec: int = DAY, how: str = "inner") -> DataFrame:
    """Each pair of an alert and an event of its symbol whose window it lies in; how left: alerts in no window too, alone.

    Both sides are dealt out by symbol and time bucket, so that one symbol's rows don't meet in one task; an event is
    repeated for each bucket that its window touches.
    """
    size = bucket_sec * NS
    e = windows_of(events, tolerance_sec).withColumnRenamed("ts_ns", "event_ts").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("we_from") / size), F.floor(F.col("we_to") / size))))
    a = alerts.withColumn("bucket", F.floor(F.col("ts_ns") / size))
    e = e.withColumnsRenamed({"symbol": "_symbol", "bucket": "_bucket"})
    meet = (F.col("symbol") == F.col("_symbol")) & (F.col("bucket") == F.col("_bucket")) & F.col("ts_ns").between(F.col("we_from"), F.col("we_to"))
    return a.join(e, meet, how).drop("bucket", "_bucket", "_symbol")


def detected(alerts: DataFrame, events: DataFrame, tolerance_sec: float, how: str = "left_semi") -> DataFrame:
    """Events with an alert in their window (left_semi) or without one (left_anti)."""
    hits = interval_join(alerts, events, tolerance_sec).select("event_no").distinct()
    return events.join(hits, "event_no", how)


def nearest_alerts(alerts: DataFrame, events: DataFrame, tolerance_sec: float, bucket_sec: int = 3_600) -> DataFrame:
    """event_no, after and before of events that have a time and a symbol: nanoseconds to the first alert of the symbol in
    an event's window at or after its time, and from the last one at or before it; null where there is none.

    No pairs are made: both sides are one relation, dealt out by symbol and time bucket, and each bucket gets two rows more,
    the last alert before it and the first one after it. Rows with an _event are events, the others alerts.
    """
    w = windows_of(events, tolerance_sec)
    e = w.select("symbol", "ts_ns", F.struct("event_no", "we_from", "we_to").alias("_event"))
    a = alerts.select("symbol", "ts_ns", F.lit(None).cast(e.schema["_event"].dataType).alias("_event"))
    alert = F.when(F.col("_event").isNull(), F.col("ts_ns"))
    rows = e.unionByName(a).where("symbol is not null and ts_ns is not null").withColumn("_bucket", F.floor(F.col("ts_ns") / (bucket_sec * NS)))
    cells = rows.groupBy("symbol", "_bucket").agg(F.min(alert).alias("_first"), F.max(alert).alias("_last"), F.count("_event").alias("_events"))
    earlier, later = (Window.partitionBy("symbol").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_bucket"), F.desc("_bucket")))  # a row a bucket
    beyond = cells.withColumns({"_before": F.max("_last").over(earlier), "_after": F.min("_first").over(later)}).where("_events > 0")
    carried = beyond.select("symbol", F.explode(F.array("_before", "_after")).alias("ts_ns"), F.lit(None).cast(e.schema["_event"].dataType).alias("_event"), "_bucket").where("ts_ns is not null")
    upto, onward = (Window.partitionBy("symbol", "_bucket").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("ts_ns"), F.desc("ts_ns")))
    seen = rows.unionByName(carried).withColumn("_before", F.max(alert).over(upto)).withColumn("_after", F.min(alert).over(onward)).where("_event is not null")
    within = lambda c: F.col(c).between(F.col("_event.we_from"), F.col("_event.we_to"))
    return seen.select("_event.event_no", F.when(within("_after"), F.col("_after") - F.col("ts_ns")).alias("after"), F.when(within("_before"), F.col("ts_ns") - F.col("_before")).alias("before"))


def time_to_detect(alerts: DataFrame, events: DataFrame, tolerance_sec: float) -> DataFrame:
    """For each detected positive event the first alert at or after it, or else the nearest before, the earliest on ties."""
    near = nearest_alerts(alerts, events.where("polarity = 'positive'"), tolerance_sec)
    best = near.groupBy("event_no").agg(F.coalesce(F.min("after"), -F.min("before")).alias("ttd_ns")).where("ttd_ns is not null")
    return best.select("event_no", "ttd_ns", (F.col("ttd_ns") / 1e6).alias("ttd_ms"))


def unattributed(alerts: DataFrame, events: DataFrame, tolerance_sec: float) -> DataFrame:
    """Alerts whose (ts_ns, symbol, kind) lies in no event's window; repeated rows stay."""
    keys = interval_join(alerts, events, tolerance_sec).select("ts_ns", "symbol", "kind").distinct()
    return alerts.join(keys, ["ts_ns", "symbol", "kind"], "left_anti")


def summary(alerts: DataFrame, events: DataFrame, tolerance_sec: float) -> DataFrame:
    """One row: detected and all positives, recall and its interval, quiet windows hit, false positives a quiet day, unattributed alerts.

    One join: each alert beside each event whose window it lies in, or alone. Whether it is attributed depends on its
    time and symbol, so counting alerts that stand alone counts the keys without an event, repeated rows included.
    """
    pairs = interval_join(alerts, events.select("event_no", "ts_ns", "symbol", "polarity", "duration_sec"), tolerance_sec, how="left")
    positive, quiet = F.col("polarity") == "positive", F.col("polarity") == "quiet"
    number = F.col("event_no")
    hits = pairs.agg(
        F.count_distinct(F.when(positive, number)).alias("detected"), F.count_distinct(F.when(quiet, number)).alias("quiet_hit"),
        F.count(F.when(quiet, 1)).alias("quiet_alerts"), F.count(F.when(number.isNull(), 1)).alias("unattributed"),
    )
    counts = events.agg(
        F.count(F.when(positive, 1)).alias("positives"), F.count(F.when(quiet, 1)).alias("quiet_windows"),
        (F.coalesce(F.sum(F.when(quiet, F.col("duration_sec"))), F.lit(0.0)) / DAY).alias("quiet_days"),
    )
    n = alerts.agg(F.count("*").alias("alerts"))
    low, high = wilson(F.col("detected"), F.col("positives"))
    one = counts.join(hits, F.lit(True)).join(n, F.lit(True))  # each is one row
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return one.select("*", rate("detected", "positives").alias("recall"), low.alias("recall_low"), high.alias("recall_high"), rate("quiet_hit", "quiet_windows").alias("quiet_rate"), rate("quiet_alerts", "quiet_days").alias("fp_per_day"))


def per_event_type(alerts: DataFrame, events: DataFrame, tolerance_sec: float) -> DataFrame:
    positive = events.where("polarity = 'positive'")
    hit = interval_join(alerts, positive, tolerance_sec).select("event_no").distinct().withColumn("hit", F.lit(1))
    e = positive.join(hit, "event_no", "left").groupBy("event_type").agg(F.count("hit").alias("detected"), F.count("*").alias("total"))
    return e.withColumn("rate", F.col("detected") / F.col("total"))


def per_kind(alerts: DataFrame, events: DataFrame, tolerance_sec: float) -> DataFrame:
    """By kind: different alerts in positive windows, alerts in quiet windows, all alerts."""
    pairs = interval_join(alerts, events, tolerance_sec)
    key = F.when(F.col("polarity") == "positive", F.struct("ts_ns", "symbol"))
    by = pairs.groupBy("kind").agg(F.count_distinct(key).alias("attributed"), F.count(F.when(F.col("polarity") == "quiet", 1)).alias("in_quiet"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return alerts.groupBy("kind").agg(F.count("*").alias("total")).join(by, "kind", "left").select("kind", zero("attributed"), zero("in_quiet"), "total")


def outside_coverage(alerts: DataFrame, events: DataFrame, tolerance_sec: float) -> DataFrame:
    """Positive events beyond the time that the alerts span, widened by the tolerance."""
    t = int(tolerance_sec * NS)
    span = alerts.agg((F.min("ts_ns") - t).alias("first"), (F.max("ts_ns") + t).alias("last"))
    return events.where("polarity = 'positive'").join(F.broadcast(span), (F.col("ts_ns") < F.col("first")) | (F.col("ts_ns") > F.col("last"))).drop("first", "last")


def time_resolution(stamps: DataFrame, column: str = "ts_ns") -> DataFrame:
    """resolution_ns: the greatest common divisor of all gaps between times, 0 if there is one time at most.

    It is that of all distances from any one of the times, so no order is needed: each task hands on one time and the
    divisor of its own distances, and what they hand on is folded once more. Nulls are left out.
    """
    rows = stamps.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("t"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, divisor = None, 0
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy()
                first = int(t[0]) if first is None else first
                divisor = math.gcd(divisor, int(np.gcd.reduce(np.abs(t - first))))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([divisor])], ["t", "g"])

    parts = rows.mapInArrow(fold, "t bigint, g bigint").agg(F.collect_list(F.struct("t", "g")).alias("_parts"))  # a row a task
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % s["b"]).alias("b"))))["a"]  # noqa: E731  # Euclid's steps, of which longs take fewer
    every = F.flatten(F.transform("_parts", lambda p: F.array(p["g"], F.abs(p["t"] - F.col("_parts")[0]["t"]))))
    return parts.select(F.aggregate(every, F.lit(0).cast("bigint"), gcd).alias("resolution_ns"))


def ttd_summary(alerts: DataFrame, events: DataFrame, tolerance_sec: float) -> DataFrame:
    """One row on the times to detection: how many, mean, upper median, how many fired before the event's own time, the
    earliest; and the median and the input's resolution in the unit that the resolution allows: days, seconds or ms."""
    ttd = time_to_detect(alerts, events, tolerance_sec).select(F.col("ttd_ns").alias("ttd"))
    middle = at_ranks(ttd, [], "ttd", {"median": F.floor(F.col("n") / 2)})
    counts = ttd.agg(F.count("*").alias("n"), F.coalesce(F.avg("ttd"), F.lit(0.0)).alias("mean"), F.count(F.when(F.col("ttd") < 0, 1)).alias("early"), F.least(F.min("ttd"), F.lit(0).cast("bigint")).alias("earliest"))
    both = alerts.select("ts_ns").unionByName(events.select("ts_ns"))
    one = counts.join(middle.select("median"), F.lit(True), "left").join(time_resolution(both), F.lit(True))
    fine, day = F.col("resolution_ns") < NS, F.lit(DAY * NS)
    size = F.when(fine, 1_000_000).when(F.col("resolution_ns") >= day, day).otherwise(NS)
    median = F.coalesce("median", F.lit(0).cast("bigint"))
    return one.select(
        "n", (F.col("mean") / 1e6).alias("mean_ms"), (median / 1e6).alias("median_ms"), "early", (F.col("earliest") / 1e6).alias("earliest_ms"), "resolution_ns",
        F.when(fine, "ms").when(F.col("resolution_ns") >= day, "day").otherwise("s").alias("unit"), (median / size).alias("median_units"), (F.col("resolution_ns") / size).alias("resolution_units"),
    )


def evaluation(alerts: DataFrame, events: DataFrame, tolerance_sec: float, kinds: list[str] | None = None) -> DataFrame:
    """All figures of an evaluation as one row; kinds leaves the other alerts out of all but the time that they cover."""
    own = alerts.where(F.col("kind").isin(kinds)) if kinds else alerts
    beside = lambda df, column: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(column))  # noqa: E731  # a row a kind or event type
    span = alerts.agg(F.min("ts_ns").alias("first_alert_ns"), F.max("ts_ns").alias("last_alert_ns"))
    missed = detected(own, events.where("polarity = 'positive'"), tolerance_sec, "left_anti").select("ts_ns", "symbol", "event_type", "description")
    outside = outside_coverage(alerts, events, tolerance_sec).agg(F.count("*").alias("outside_coverage"))
    one = poisson_intervals(summary(own, events, tolerance_sec).withColumn("quiet_alerts", F.col("quiet_alerts").cast("long")), "quiet_alerts", "quiet_days")
    for part in (ttd_summary(own, events, tolerance_sec), span, outside, beside(per_event_type(own, events, tolerance_sec), "per_event_type"), beside(per_kind(own, events, tolerance_sec), "per_kind"), beside(missed, "missed_events")):
        one = one.join(part, F.lit(True))
    return one


def artifact(spark: SparkSession, alerts_path: str, events_path: str, tolerance_sec: float, kinds: list[str] | None = None) -> DataFrame:
    """One row with one JSON text: an evaluation of two files, with their paths and content hashes, the settings and the time."""
    alerts = alerts_csv(spark, alerts_path)
    events = catalog_csv(spark, events_path).withColumn("event_no", F.monotonically_increasing_id())
    result = evaluation(alerts, events, tolerance_sec, kinds)
    hashed = lambda path, name: file_sha256(spark, path).select(F.col("sha256").alias(name))
    one = result.select(F.struct("*").alias("results")).join(hashed(alerts_path, "alerts_sha256"), F.lit(True)).join(hashed(events_path, "events_sha256"), F.lit(True))
    inputs = F.struct(
        F.lit(alerts_path).alias("alerts_path"), "alerts_sha256", F.lit(events_path).alias("events_path"), "events_sha256", F.lit(float(tolerance_sec)).alias("tolerance_sec"),
        F.array(*map(F.lit, kinds or [])).cast("array<string>").alias("kinds"),
    )
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return one.select(F.to_json(F.struct(F.lit("driftwatch.evaluation/1").alias("schema"), at.alias("generated_at"), inputs.alias("inputs"), "results")).alias("json"))
