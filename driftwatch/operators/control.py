"""What settings, watchlists and switches do to tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(defaults: DataFrame, *layers: DataFrame) -> DataFrame:
    """Settings (name, value), each taken from the last layer that has it; layers' names that the defaults lack are ignored, null values too."""
    out = defaults.select("name", F.col("value").alias("v0"))
    for k, layer in enumerate(layers, 1):
        out = out.join(layer.groupBy("name").agg(F.max("value").alias(f"v{k}")), "name", "left")
    value = F.coalesce(*(f"v{k}" for k in range(len(layers), -1, -1)))
    return out.select("name", value.alias("value"), (~value.eqNullSafe(F.col("v0"))).alias("overridden"))


def while_active(events: DataFrame, switches: DataFrame, bucket_sec: int = 86_400) -> DataFrame:
    """Events at whose time the last switch (ts_ns, active) was on, or that come before the first. What comes while it is off is dropped for good.

    Of switches at one time the one that turns on holds; a null is no switch. Switches are ordered within time buckets,
    and a row a bucket carries the last one over. They become spans of inactivity, dealt out by time bucket like the
    events; a span without end is one row.
    """
    size = bucket_sec * 1_000_000_000
    own = switches.where("active is not null").select("ts_ns", "active", F.floor(F.col("ts_ns") / size).alias("_bucket"))
    inside, buckets = Window.partitionBy("_bucket").orderBy("ts_ns", "active"), Window.orderBy("_bucket")  # a row a bucket
    carried = own.groupBy("_bucket").agg(F.max_by("active", F.struct("ts_ns", "active")).alias("_last")).select("_bucket", F.lag("_last").over(buckets).alias("_carried"))
    before = F.coalesce(F.lag("active").over(inside), "_carried")
    turned = own.join(carried, "_bucket").withColumn("_before", before).where("_before is null or active <> _before").select("ts_ns", "active", "_bucket")
    later = turned.groupBy("_bucket").agg(F.min("ts_ns").alias("_first")).select("_bucket", F.lead("_first").over(buckets).alias("_next"))
    spans = turned.join(later, "_bucket").select(F.col("ts_ns").alias("_from"), "active", F.coalesce(F.lead("ts_ns").over(inside), "_next").alias("_to")).where("not active")
    last = spans.where("_to is null").select("_from")
    closed = spans.where("_to is not null").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(F.col("_to") / size))))
    off = (F.floor(F.col("ts_ns") / size) == F.col("_bucket")) & (F.col("ts_ns") >= F.col("_from")) & (F.col("ts_ns") < F.col("_to"))
    return events.join(closed, off, "left_anti").join(F.broadcast(last), F.col("ts_ns") >= F.col("_from"), "left_anti")


def reconcile(desired: DataFrame, current: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Changes (symbol, change) from the current to the desired symbols. Blank and null ones don't count; symbols are
    trimmed and in upper case. An empty desired set changes nothing unless that is allowed."""
    normal = lambda df: df.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct()
    want, have = normal(desired), normal(current)
    changes = want.exceptAll(have).withColumn("change", F.lit("add")).unionByName(have.exceptAll(want).withColumn("change", F.lit("remove")))
    if allow_empty:
        return changes
    some = want.agg((F.count("*") > 0).alias("_some"))  # one row
    return changes.join(F.broadcast(some), F.lit(True)).where("_some").drop("_some")


def watched(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """Events of the symbols on a list; in a micro-batch the list is read anew."""
    return events.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def drained(events: DataFrame, max_events: int) -> DataFrame:
    """The first max_events events in order of time, which the caller's limit asks for."""
    return events.orderBy("ts_ns", "seq").limit(max_events)


def health(alive: Column, connected: Column, age_sec: Column, uptime_sec: Column, stale_sec: Column) -> Column:
    """Status of a service: is its detector alive; is its feed connected (null: no such feed); seconds since its last tick
    (null: none yet); seconds since its start; seconds after which its feed counts as stale (null: 0)."""
    grace = F.greatest(F.lit(60.0), F.coalesce(stale_sec, F.lit(0.0)))
    return (
        F.when(~F.coalesce(alive, F.lit(False)), "down").when(~connected, "reconnecting")
        .when(age_sec.isNull(), F.when(uptime_sec < grace, "starting").otherwise("degraded"))
        .when(age_sec > 30.0, "degraded").otherwise("ok")
    )


def inspection(alerts: DataFrame, recent: int = 500, top: int = 10) -> DataFrame:
    """A report on the latest alerts: section, key, n, per_min, p50, p95, most. Sections: all, kind, symbol, symbol x kind, top, within 1, 10 and 60 s.

    Percentiles and maxima are of abs(score), by rank from below. The report looks at ``recent`` alerts, as it is asked to.
    """
    ring = alerts.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(recent)
    span = ring.agg(((F.max("ts_ns") - F.min("ts_ns")) / 6e10).alias("_m"))
    # some hundred numbers a group
    scores, n = F.array_sort(F.collect_list(F.abs("score"))), F.count("*")
    at = lambda p: F.get(F.col("_s"), F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)).cast("int"))

    def counted(section: str, *keys: str) -> DataFrame:
        key = F.concat_ws(" x ", *keys) if keys else F.lit("*")
        by = ring.groupBy(*keys).agg(n.alias("n"), scores.alias("_s"))
        return by.select(F.lit(section).alias("section"), key.alias("key"), "n", at(50).alias("p50"), at(95).alias("p95"), F.array_max("_s").alias("most"))

    none = F.lit(None).cast("double")
    sections = [counted("all"), counted("kind", "kind"), counted("symbol", "symbol"), counted("symbol x kind", "symbol", "kind")]
    ranked = ring.withColumn("_k", F.row_number().over(Window.orderBy(F.abs("score").desc(), "ts_ns", "seq"))).where(F.col("_k") <= top)
    sections.append(ranked.select(F.lit("top").alias("section"), F.concat_ws(" ", F.lpad(F.col("_k").cast("string"), 2, "0"), "symbol", "kind").alias("key"), F.lit(1).cast("bigint").alias("n"), none.alias("p50"), none.alias("p95"), F.abs("score").alias("most")))
    for s in (1, 10, 60):
        w = Window.orderBy("ts_ns").rangeBetween(-s * 1_000_000_000, 0)
        sections.append(ring.select(F.count("*").over(w).alias("n")).agg(F.max("n").alias("n")).select(F.lit("within").alias("section"), F.lit(f"{s} s").alias("key"), "n", none.alias("p50"), none.alias("p95"), none.alias("most")))
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    per_min = F.when(F.col("section").isin("all", "kind", "symbol"), F.col("n") / F.greatest("_m", F.lit(1e-6)))
    return out.join(F.broadcast(span), F.lit(True)).select("section", "key", "n", per_min.alias("per_min"), "p50", "p95", "most")  # one row
