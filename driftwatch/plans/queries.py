"""The queries over the test tables by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.functions import scalar as S
from driftwatch.operators import asof as A
from driftwatch.operators import born as B
from driftwatch.operators import control as C
from driftwatch.operators import detect as D
from driftwatch.operators import evaluate as E
from driftwatch.operators import gates as G
from driftwatch.operators import models as M
from driftwatch.operators import windows as W
from driftwatch.operators.kernels import Params
from driftwatch.operators.pieces import kept
from driftwatch.operators.table_function import register_detectors
from driftwatch.sources import files
from driftwatch.sources import views as V
from driftwatch.streaming import live, mail
from driftwatch.streaming import windows as T

#: Half an hour on either side of a point event. The test events are sparse: gaps of hours don't end a session there.
TOLERANCE = 1800.0
PARAMS = Params(session_gap=604_800.0, regime_short=50, regime_ref=100, regime_stride=5, regime_check=50)
RETURNS = [f"r{k}" for k in range(V.ASSETS)]
LONG_RETURNS = "stack(8, 0, r0, 1, r1, 2, r2, 3, r3, 4, r4, 5, r5, 6, r6, 7, r7) as (asset, ret)"
ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    ALL[f.__name__] = f
    return f


def r(column, digits: int = 6):
    """Rounded, and never a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


# Scans and sinks
@query
def scan_symbol_filter(spark, d):
    return V.ticks(spark, d).where("symbol = 'click'").select("ts_ns", "symbol", "price")


@query
def unpivot_bars(spark, d):
    wide = V.prices(spark, d).groupBy("d").pivot("asset", list(range(8))).agg(F.first("px"))
    long = wide.unpivot("d", [str(k) for k in range(8)], "symbol", "close").where("close is not null")
    return long.select((F.unix_date("d").cast("bigint") * 86_400_000_000_000).alias("ts_ns"), "symbol", r("close").alias("close"))


@query
def catalog_validate(spark, d):
    """The labelled events with faults in some: a polarity that is none, a time below zero, none at all."""
    c = V.catalog(spark, d).select(
        F.when(F.col("event_no") % 5 == 0, F.col("symbol")).otherwise(F.col("polarity")).alias("polarity"),
        F.when(F.col("event_no") % 7 == 0, -1.0).otherwise(F.col("duration_sec")).alias("duration_sec"), F.when(F.col("event_no") % 11 != 0, F.col("ts_ns")).alias("ts_ns"),
    )
    bad = ~F.col("polarity").isin("positive", "quiet") | (F.col("duration_sec") < 0) | F.col("ts_ns").isNull()
    return c.groupBy("polarity").agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("n_bad"), F.sum("duration_sec").alias("quiet_sec"))


@query
def alert_export_format(spark, d):
    return V.alerts(spark, d).select("ts_ns", "symbol", "kind", S.text_of(F.col("price"), ".6f").alias("price"), S.text_of(F.col("score"), ".4f").alias("score"))


@query
def webhook_payload(spark, d):
    """Prices in cents and scores in thousandths, so that both engines write the same digits."""
    a = V.alerts(spark, d).withColumn("price", F.round(F.col("price") * 100).cast("bigint")).withColumn("score", F.round(F.col("score") * 1000).cast("bigint"))
    return live.webhook_bodies(a, "crypto", 12_000.0, window_sec=3600)


@query
def health_status(spark, d):
    """Each user's events as a service: its detector died with a last event error, its feed is off after a last event
    signup; users whose last event is a click have no feed to ask."""
    now = V.table(spark, d, "events").agg(F.max("ts").alias("now"))
    seconds = lambda a, b: (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 1e6
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    u = V.table(spark, d, "events").groupBy("user_id").agg(last.alias("last"), F.max(F.when(F.col("value") > 20, F.col("ts"))).alias("tick"), F.min("ts").alias("start"))
    x = u.join(F.broadcast(now), F.lit(True))  # one row
    connected = F.when(F.col("last") != "click", F.col("last") != "signup")
    return x.select("user_id", C.health(F.col("last") != "error", connected, seconds("now", "tick"), seconds("now", "start"), F.lit(86_400.0)).alias("status"))


@query
def tick_export_format(spark, d):
    return V.ticks(spark, d).select("ts_ns", "symbol", S.text_of(F.col("price"), ".6f").alias("price"))


@query
def wide_to_replay(spark, d):
    return files.wide_to_ticks(V.wide_prices(spark, d), "d", "p3").select("ts_ns", "symbol", r("price").alias("price"))


# Settings, watchlists, switches
@query
def config_overlay(spark, d):
    """Defaults by part brand, a layer of the dearer parts, then one of the largest."""
    p = V.table(spark, d, "part").select(F.col("p_brand").alias("name"), "p_size", "p_retailprice")
    of = lambda where, value: p.where(where).groupBy("name").agg(F.max(value).cast("string").alias("value"))
    return C.overlay(of("true", F.lit(0)), of("p_retailprice > 1500", "p_size"), of("p_size >= 50", F.lit("large")))


@query
def pause_resume(spark, d):
    """Very high prices switch the detectors off, very low ones on again."""
    t = V.ticks(spark, d)
    switches = t.where("price >= 300 or price < 0.5").groupBy("ts_ns").agg((F.min("price") < 0.5).alias("active"))
    return C.while_active(t, switches).select("seq", "symbol")


@query
def watchlist_guard(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("symbol"), "c_acctbal")
    current = c.where("c_acctbal < 5000 and symbol < 'F'")
    some = C.reconcile(c.where("symbol > 'B'"), current).withColumn("case", F.lit("some"))
    empty = C.reconcile(c.where("c_acctbal > 1e9"), current).withColumn("case", F.lit("empty"))
    cleared = C.reconcile(c.where("c_acctbal > 1e9"), current, allow_empty=True).withColumn("case", F.lit("cleared"))
    return some.unionByName(empty).unionByName(cleared)


@query
def drain_limit(spark, d):
    return C.drained(V.ticks(spark, d), 2000).groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts_ns").alias("last"))


@query
def inspection_report(spark, d):
    x = C.inspection(V.alerts(spark, d))
    return x.select("section", "key", "n", r("per_min").alias("per_min"), r("p50").alias("p50"), r("p95").alias("p95"), r("most").alias("most"))


@query
def raw_ticks_dedup(spark, d):
    return V.ticks(spark, d).select("symbol", "price").distinct().groupBy("symbol").agg(F.count("*").alias("n_prices"))


# Scalar functions
@query
def log_return(spark, d):
    return W.log_return(V.ticks(spark, d)).where("log_return is not null").select("symbol", "seq", r("log_return", 9).alias("log_return"))


@query
def spread_bps(spark, d):
    return V.quotes(spark, d).select("seq", r(S.spread_bps()).alias("spread_bps"), r(S.mid()).alias("mid"))


@query
def obi(spark, d):
    return V.quotes(spark, d).select("seq", r(S.imbalance(), 9).alias("obi"))


@query
def microprice_drift_value(spark, d):
    return V.quotes(spark, d).select("seq", r(S.microprice_drift()).alias("drift"))


@query
def quote_rate(spark, d):
    return W.quote_rate(V.quotes(spark, d)).select("symbol", "seq", r("rate", 9).alias("rate"))


@query
def severity(spark, d):
    return V.alerts(spark, d).withColumn("severity", S.severity()).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query
def narrative(spark, d):
    a = V.alerts(spark, d).withColumn("details", F.when(F.col("kind") == "robust_z", '{"z_threshold": 4.0}').when(F.col("kind") == "cusum", '{"cusum_h": 5.0}').otherwise('{"alerts_in_window": 7, "window_sec": 10.0, "intensity_ratio": 3.5}'))
    return a.select("seq", S.narrative().alias("narrative"))


@query
def symbol_feed_mismatch(spark, d):
    raw = V.table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "/usd ").otherwise(" ")).alias("raw"), F.when(F.col("c_custkey") % 2 == 0, "crypto").otherwise("iex").alias("feed"))
    symbol = S.normal_symbol(F.col("raw"))
    return raw.select(symbol.alias("symbol"), "feed", (symbol.contains("/") != (F.col("feed") == "crypto")).alias("mismatch")).groupBy("symbol", "feed", "mismatch").agg(F.count("*").alias("n"))


@query
def parse_rfc3339_ns(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000).cast("string"), 6, "0"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("Z")).alias("text"))
    return e.select("event_id", S.rfc3339_ns(F.col("text")).alias("ts_ns"))


# Joins
@query
def event_alert_interval_join(spark, d):
    return E.interval_join(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE).select("event_no", "seq", "symbol", "polarity", "kind")


@query
def detected_events(spark, d):
    return E.detected(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE).select("event_no", "polarity")


@query
def missed_events(spark, d):
    return E.detected(V.alerts(spark, d), V.catalog(spark, d).where("polarity = 'positive'"), TOLERANCE, "left_anti").select("event_no")


@query
def unattributed_alerts(spark, d):
    return E.unattributed(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE).select("seq", "kind")


@query
def time_to_detect(spark, d):
    return E.time_to_detect(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE).select("event_no", r("ttd_ms", 3).alias("ttd_ms"))


@query
def latest_quote(spark, d):
    q = V.quotes(spark, d)
    last = q.groupBy("symbol").agg(F.max_by(F.struct("bid", "ask", "bid_size", "ask_size"), F.struct("ts_ns", "seq")).alias("q")).select("symbol", "q.*").where("ask > bid and bid > 0")
    return last.select("symbol", r("bid").alias("bid"), r("ask").alias("ask"), "bid_size", "ask_size", r(S.mid()).alias("mid"), r(S.spread_bps()).alias("spread_bps"))


@query
def threshold_override(spark, d):
    own = spark.createDataFrame([("click", 2.0), ("error", 9.0)], "symbol string, own double")  # a setting: two rows
    z = F.coalesce("own", F.lit(4.0))
    return V.alerts(spark, d).join(F.broadcast(own), "symbol", "left").where(F.abs("score") > z).groupBy("symbol").agg(F.count("*").alias("n"), F.max(z).alias("z_thresh"))


# Aggregates
@query
def alert_counts(spark, d):
    sets = V.alerts(spark, d).groupingSets([["kind"], ["symbol"], ["kind", "symbol"]], "kind", "symbol").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("symbol", F.lit("*")).alias("symbol"), "n")


@query
def score_stats(spark, d):
    return V.alerts(spark, d).groupBy("kind").agg(r(F.avg(F.abs("score"))).alias("mean_abs"), r(F.max(F.abs("score"))).alias("max_abs"))


@query
def percentiles_linear(spark, d):
    t = V.ticks(spark, d)
    p = W.percentiles(t, ["symbol"], "price", {"p0": 0.5, "p1": 0.95, "p2": 0.99, "p3": 0.999})
    rest = t.groupBy("symbol").agg(r(F.avg("price")).alias("mean"), F.max("price").alias("max"))
    return p.join(rest, "symbol").select("symbol", *(r(f"p{k}").alias(f"p{k}") for k in range(4)), "mean", "max")


@query
def percentiles_rank(spark, d):
    rank = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
    return W.at_ranks(V.ticks(spark, d), ["symbol"], "price", {f"p{p}": rank(p) for p in (50, 90, 99)})


@query
def alert_rates(spark, d):
    minutes = F.greatest((F.max("ts_ns") - F.min("ts_ns")) / 6e10, F.lit(1e-6))
    return V.alerts(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), r(minutes).alias("span_min"), r(F.count("*") / minutes, 9).alias("per_min"))


@query
def throughput(spark, d):
    span = (F.max("ts_ns") - F.min("ts_ns")) / 1e9
    return V.ticks(spark, d).groupBy("symbol").agg(r(F.when(span > 0, F.count("*") / span).otherwise(F.count("*").cast("double")), 12).alias("per_sec"))


@query
def evaluate_summary(spark, d):
    s = E.summary(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE)
    return s.select("detected", "positives", "quiet_hit", "quiet_windows", "quiet_alerts", "unattributed", "alerts", *(r(c).alias(c) for c in ("quiet_days", "recall", "recall_low", "recall_high", "quiet_rate", "fp_per_day")))


@query
def per_event_type(spark, d):
    return E.per_event_type(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE).withColumn("rate", r("rate"))


@query
def per_kind(spark, d):
    return E.per_kind(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE)


@query
def outside_coverage(spark, d):
    """Alerts of the highest scores alone, which span less time than the events."""
    return E.outside_coverage(V.alerts(spark, d).where("score >= 14.5"), V.catalog(spark, d), TOLERANCE).select("event_no")


@query
def ttd_summary(spark, d):
    x = E.ttd_summary(V.alerts(spark, d), V.catalog(spark, d), TOLERANCE)
    return x.select("n", "early", "resolution_ns", "unit", *(r(c, 3).alias(c) for c in ("mean_ms", "median_ms", "earliest_ms", "median_units", "resolution_units")))


@query
def ts_resolution(spark, d):
    """Of all alerts' and events' times; those of daily prices; and those of a grid of three minutes."""
    both = V.alerts(spark, d).select("ts_ns").union(V.catalog(spark, d).select("ts_ns"))
    days = V.prices(spark, d).select((F.unix_date("d").cast("bigint") * 86_400_000_000_000).alias("ts_ns"))
    grid = V.ticks(spark, d).select((F.floor(F.col("ts_ns") / 180_000_000_000) * 180_000_000_000 + 7).alias("ts_ns"))
    parts = [E.time_resolution(x).withColumn("times", F.lit(name)) for name, x in (("alerts", both), ("days", days), ("grid", grid))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def price_delta(spark, d):
    first, last = (f("price", F.struct("ts_ns", "seq")) for f in (F.min_by, F.max_by))
    return V.ticks(spark, d).groupBy("symbol").agg(first.alias("first_price"), last.alias("last_price"), r((last - first) / first * 100).alias("delta_pct"))


@query
def wilson_ci(spark, d):
    counts = V.alerts(spark, d).groupBy("symbol").agg(F.count(F.when(F.col("kind") == "cusum", 1)).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return counts.select("symbol", r(low, 9).alias("low"), r(high, 9).alias("high"))


@query
def joint_pmf(spark, d):
    return M.joint_pmf(V.returns(spark, d), ["r0", "r1", "r2"]).withColumn("p", r("p", 9))


# Windows, sorting, sets
@query
def rolling_sum5(spark, d):
    """Of eight series side by side."""
    x = V.returns(spark, d).selectExpr("t", LONG_RETURNS)
    return W.rolling_sum(x, "t", "ret", 5, "s", keys=("asset",)).select("t", "asset", r("s", 9).alias("s"))


@query
def null_z(spark, d):
    """Of eight series side by side."""
    x = V.returns(spark, d).selectExpr("t", LONG_RETURNS)
    return W.null_scores(x, "ret", keys=("asset",)).select("t", "asset", r("z").alias("z"))


@query
def peak_drop(spark, d):
    x = V.returns(spark, d).selectExpr("t", LONG_RETURNS)
    return x.groupBy("asset").agg(F.min_by("t", F.struct("ret", "t")).alias("t"), r(F.min("ret"), 9).alias("ret"))


@query
def burst_max_window(spark, d):
    a = W.within_each(V.alerts(spark, d), {f"n{n}": n for n in (1, 10, 3600)})
    return a.groupBy("symbol").agg(*(F.max(f"n{n}").alias(f"n{n}") for n in (1, 10, 3600)))


@query
def rolling_alert_density(spark, d):
    return W.within(V.alerts(spark, d), 6 * 3600).select("seq", "n_within")


@query
def realized_vol(spark, d):
    """Of eight series side by side."""
    x = W.realized_volatility(V.returns(spark, d).selectExpr("t", LONG_RETURNS), "t", "ret", 20, keys=("asset",)).where("vol is not null")
    middle = x.groupBy("asset").agg(F.percentile("vol", F.lit(0.5)).alias("m"))
    return x.join(middle, "asset").select("t", "asset", r("vol", 9).alias("vol"), (F.col("vol") < F.col("m")).alias("below_median"))


def _gate_scores(spark, d):
    """Two scores of the same days, and a volatility: rolling sums of two returns against all days."""
    x = V.returns(spark, d)
    of = lambda name: W.null_scores(W.rolling_sum(x, "t", name, 5, "s"), "s", f"z_{name}").select("t", f"z_{name}")
    return of("r0").join(of("r1"), "t").join(W.realized_volatility(x, "t", "r2", 20).select("t", "vol"), "t")


@query
def quiet_windows(spark, d):
    return W.quiet_starts(_gate_scores(spark, d), "t", "z_r0", "vol", calm=2.5)


@query
def gate_corroboration(spark, d):
    x = G.corroboration(_gate_scores(spark, d), "z_r0", "z_r1", 2.0, 1.5)
    return x.select("n_reference", "n_new", "n_both", "n_new_alone", r("corroborated").alias("corroborated"), r("lift").alias("lift"))


@query
def gate_quiet_firings(spark, d):
    x = _gate_scores(spark, d)
    return G.quiet_firings(x, "t", "z_r1", W.quiet_starts(x, "t", "z_r0", "vol", calm=2.5), new_thresh=1.0).withColumn("per_day", r("per_day"))


def _onsets(spark, d):
    """Crises: the days of the deepest fall of r0's rolling sum in each of three stretches; and the quiet windows' starts."""
    x = _gate_scores(spark, d)
    crisis = x.where("t between 300 and 2099").groupBy(F.floor((F.col("t") - 300) / 600).alias("k")).agg(F.min(F.struct(F.round("z_r0", 9), "t")).alias("b"))
    quiet = W.quiet_starts(x, "t", "z_r0", "vol", calm=2.5)
    named = lambda df, kind, onset: df.select(F.concat(F.lit(f"{kind} "), onset.cast("string")).alias("event"), F.lit(kind).alias("type"), onset.alias("onset"))
    return named(crisis, "crisis", F.col("b.t")).unionByName(named(quiet, "quiet", F.col("start")))


def _gate_runs(spark, d):
    """Peaks of models of single columns, which SQL can express; some tens of rows that a verdict looks at many times."""
    x = G.event_windows(V.returns(spark, d), kept(_onsets(spark, d)))
    return kept(G.peaks(G.marginal_scores(x, RETURNS)).withColumn("peak_z", F.round("peak_z", 9)))


@query
def gate_peaks(spark, d):
    return _gate_runs(spark, d).withColumn("peak_z", r("peak_z"))


@query
def gate_copulas(spark, d):
    """Peaks of the copulas, five models an event."""
    x = G.event_windows(V.returns(spark, d), kept(_onsets(spark, d)))
    return G.peaks(G.copula_scores(x, RETURNS)).withColumn("peak_z", r("peak_z"))


@query
def gate_stability(spark, d):
    """Born machines of four returns, in pairs of windows a year long."""
    x = B.stability(V.returns(spark, d), RETURNS[:4])
    return x.select("start", r("divergence", 3).alias("divergence"), "c4", "c5")


@query
def gate_merge(spark, d):
    x = G.merged(_gate_runs(spark, d))
    return x.select("event", "best", "best_day", "gauss_day", "t_day", *(r(c).alias(c) for c in ("best_z", "gauss_z", "t_z")))


@query
def gate_best(spark, d):
    return G.best_by_event(_gate_runs(spark, d), "mps_").select("event", "best", r("best_z").alias("best_z"))


@query
def gate_verdict(spark, d):
    return G.verdict(_gate_runs(spark, d)).withColumn("threshold", r("threshold"))


@query
def sessionize(spark, d):
    s = W.sessions(V.ticks(spark, d), 3600)
    return s.groupBy("symbol", "session").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"))


@query
def ref_eval_slice(spark, d):
    """Around day 600: 252 rows that end 30 before it, and 20 from it on."""
    part = F.when(F.col("t").between(600 - 30 - 252, 600 - 31), "ref").when(F.col("t").between(600, 619), "eval")
    return V.returns(spark, d).select("t", part.alias("part"), r("r0", 9).alias("r0")).where("part is not null")


@query
def alert_history(spark, d):
    a = V.alerts(spark, d).where("symbol = 'view' and kind = 'cusum' and ts_ns >= 1704672000000000000")
    return a.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(50).select("ts_ns", "seq", "price", r("score").alias("score"), S.severity().alias("severity"))


@query
def topk_score(spark, d):
    return V.alerts(spark, d).orderBy(F.abs("score").desc(), "seq").limit(10).select("seq", "symbol", r("score").alias("score"))


@query
def recent_n(spark, d):
    return V.alerts(spark, d).orderBy(F.desc("ts_ns"), F.desc("seq")).limit(500).select("ts_ns", "seq", "symbol", "kind")


@query
def watchlist_diff(spark, d):
    c, s = V.table(spark, d, "customer"), V.table(spark, d, "supplier")
    wanted, current = c.select(F.col("c_nationkey").alias("k")).where("k < 20").distinct(), s.select(F.col("s_nationkey").alias("k")).where("k > 3").distinct()
    return wanted.exceptAll(current).withColumn("change", F.lit("add")).unionByName(current.exceptAll(wanted).withColumn("change", F.lit("remove")))


@query
def digest_windows(spark, d):
    return live.digests(V.alerts(spark, d), 60, 6.0, 3600)


@query
def ffill_limit2(spark, d):
    return V.wide_prices(spark, d).select("d", *(r(f"p{k}").alias(f"p{k}") for k in range(8)))


@query
def log_returns(spark, d):
    return V.returns(spark, d).select("t", *(r(c, 9).alias(c) for c in RETURNS))


# What was known at a time, and windows by event time
@query
def trade_quote_asof(spark, d):
    """Each trade beside the last quote before it; a trade comes before the quote of its own number."""
    e = V.event_stream(spark, d)
    trades, quotes = e.where("etype = 't'").select("symbol", "ts_ns", "seq", "price"), e.where("etype = 'q'")
    x = A.asof(trades, quotes, ["bid", "ask"])
    return x.select("symbol", "seq", "price", (F.col("ts_ns") - F.col("right_ts")).alias("age_ns"), r("bid").alias("bid"), r("ask").alias("ask"))


@query
def context_snapshot(spark, d):
    x = A.context(V.event_stream(spark, d), 1000)
    ends = lambda f, c: getattr(F, f)(c)
    total = F.aggregate("prices", F.lit(0.0), lambda s, p: s + p)
    quote = [r(f"quote.{c}").alias(c) for c in ("bid", "ask", "bid_size", "ask_size", "mid", "spread_bps")]
    return x.select("symbol", F.size("prices").cast("bigint").alias("n"), ends("array_min", "ts_ns").alias("first_ns"), F.element_at("ts_ns", -1).alias("last_ns"), r(F.element_at("prices", -1)).alias("last_price"), r(total, 3).alias("total"), *quote)


@query
def alert_rate_windows(spark, d):
    """Windows of six hours, a new one every two."""
    return T.alert_windows(V.alerts(spark, d), 21_600, 7_200).withColumn("most", r("most"))


@query
def alert_sessions(spark, d):
    return T.alert_sessions(V.alerts(spark, d), 14_400).withColumn("most", r("most"))


@query
def digest_mails(spark, d):
    """What the sender of digests tells of all alerts, with an hour's silence by symbol."""
    x = mail.mails(V.alerts(spark, d), "crypto", 60, 6.0, 3600)
    return x.select("digest_ns", "part", "n", "n_symbols", "subject", F.length("body").alias("body_chars"))


@query
def detector_sql(spark, d):
    """full_detector by the table function."""
    register_detectors(spark, PARAMS)
    V.event_stream(spark, d).createOrReplaceTempView("driftwatch_events")
    x = spark.sql("SELECT * FROM detect_alerts(TABLE(driftwatch_events) PARTITION BY symbol ORDER BY (ts_ns, seq))")
    return x.select("symbol", "seq", "ord", "kind", r("price").alias("price"), r("score").alias("score"))


@query
def detected_alerts_evaluation(spark, d):
    """Robust z alerts, as the detector gives them, against the labelled events."""
    a = D.robust_z_alerts(V.ticks(spark, d), PARAMS).select("ts_ns", "symbol", F.lit("robust_z").alias("kind"), F.col("z").alias("score"))
    x = E.summary(a, V.catalog(spark, d), TOLERANCE)
    return x.select("alerts", "detected", "positives", "quiet_windows", "quiet_hit", "quiet_alerts", "unattributed", r("recall").alias("recall"), r("fp_per_day").alias("fp_per_day"))


# Models
@query
def rank_uniform(spark, d):
    x = V.returns(spark, d).selectExpr("t", LONG_RETURNS)
    return M.rank_uniform(x, "ret", ["asset"]).select("t", "asset", r("u", 9).alias("u"))


@query
def ecdf_transform(spark, d):
    x = V.returns(spark, d).selectExpr("t", "t <= 252 as ref", LONG_RETURNS)
    return M.ecdf(x, "ret", "ref", ["asset"]).select("t", "asset", r("u", 9).alias("u"))


@query
def kendall_tau(spark, d):
    return M.kendall_tau(V.returns(spark, d), "t", ["r0", "r1", "r2", "r3"]).withColumn("tau", r("tau", 9))


@query
def ks_two_sample(spark, d):
    x = V.returns(spark, d).selectExpr("t <= 252 as ref", LONG_RETURNS)
    return M.ks_two_sample(x, "ret", "ref", "asset").withColumn("ks", r("ks", 9))


@query
def t_copula_score(spark, d):
    x = M.walk_forward(V.returns(spark, d), RETURNS)
    return x.select("t", r("z").alias("z"), "df")


@query
def dependence_shift(spark, d):
    x = M.dependence_shift(V.returns(spark, d), RETURNS)
    return x.select("symbol", "t", r("price").alias("price"), r("score").alias("score"), "df", "alert")


@query
def poisson_ci(spark, d):
    counts = V.alerts(spark, d).where("abs(score) >= 12").groupBy("symbol").agg(F.count("*").alias("k"), ((F.max("ts_ns") - F.min("ts_ns")) / 8.64e13).alias("days"))
    return M.poisson_intervals(counts, "k", "days").select("symbol", "k", r("rate_low").alias("rate_low"), r("rate_high").alias("rate_high"))


@query
def walk_forward(spark, d):
    x = M.walk_forward(V.returns(spark, d), RETURNS)
    return x.where("abs(z) >= 3").select("t", r("z").alias("score"), r("rolling_ll").alias("price"))


# Detectors
@query
def obi_hysteresis(spark, d):
    q = V.quotes(spark, d).withColumn("obi", S.imbalance())
    return W.hysteresis(q, "obi", 0.9, 0.5).select("symbol", "seq", r("obi", 9).alias("obi"))


@query
def crossed_book(spark, d):
    return D.crossed_books(V.quotes(spark, d)).select("symbol", "seq", r("score", 9).alias("score"))


@query
def ewma_mad(spark, d):
    x = D.price_scores(V.ticks(spark, d), PARAMS)
    last = F.struct("ts_ns", "seq")
    return x.groupBy("symbol").agg(F.count("z").alias("n_scored"), r(F.max_by("mean", last), 9).alias("mean"), r(F.max_by("mad", last), 9).alias("mad"))


def _of_kind(spark, d, kind, events, params=PARAMS):
    return D.detect(events, params, kinds=[kind]).select("symbol", "seq", r("score").alias("score"))


@query
def robust_z_alerts(spark, d):
    return D.robust_z_alerts(V.ticks(spark, d), PARAMS).select("symbol", "seq", r("z").alias("score"))


@query
def cusum_alerts(spark, d):
    return _of_kind(spark, d, "cusum", D.from_ticks(V.ticks(spark, d)))


@query
def volume_spike(spark, d):
    return D.volume_spikes(V.ticks(spark, d), Params(vol_z=1.2)).select("symbol", "seq", r("z").alias("z"))


@query
def microprice_drift(spark, d):
    return D.microprice_drifts(V.quotes(spark, d), Params(micro_z=1.6)).select("symbol", "seq", r("z").alias("z"))


@query
def p2_quantile(spark, d):
    x = D.p2_quantiles(V.ticks(spark, d), "price")
    return x.select("symbol", "n", *(r(c).alias(c) for c in ("q25", "q50", "q75")))


@query
def spread_widen(spark, d):
    return _of_kind(spark, d, "spread_widen", D.from_quotes(V.quotes(spark, d)), Params(spread_z=0.9))


@query
def quote_rate_spike(spark, d):
    return _of_kind(spark, d, "quote_rate_spike", D.from_quotes(V.quotes(spark, d)))


@query
def burst(spark, d):
    p = Params(session_gap=604_800.0, z_thresh=2.0, cusum_h=3.0, burst_window=86_400.0, burst_k=2.0, burst_cooldown=86_400.0)
    return _of_kind(spark, d, "burst", D.from_ticks(V.ticks(spark, d)), p)


@query
def regime_shift(spark, d):
    return _of_kind(spark, d, "regime_shift", D.from_ticks(V.ticks(spark, d)), replace(PARAMS, regime_ks=0.17, regime_cooldown=86_400.0))


@query
def full_detector(spark, d):
    return D.detect(V.event_stream(spark, d), PARAMS).select("symbol", "seq", "ord", "kind", r("price").alias("price"), r("score").alias("score"))


@query
def sweep_grid(spark, d):
    x = D.sweep(V.ticks(spark, d), [2.0, 3.0, 4.0], [3.0, 5.0, 8.0], PARAMS)
    return x.select("z_thresh", "cusum_h", "z_alerts", "cusum_alerts", r("pct_ticks").alias("pct_ticks"), r("max_abs_score").alias("max_abs_score"))
