"""Operators over tables against plain Python, on small tables with nulls, ties and gaps."""

import hashlib
import json
import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.operators import control, evaluate, gates, models, windows
from driftwatch.sources import files
from driftwatch.streaming import live

DAY, NS = 86_400 * 10**9, 10**9
ALERTS = "symbol string, ts_ns bigint, seq bigint, ord int, kind string, price double, score double, details string"


@pytest.mark.parametrize("seed", range(4))
def test_summary_against_loops(spark, seed):
    """Random alerts, points in time and quiet weeks of two symbols, some at one time or at a window's very end."""
    rng = random.Random(seed)
    tolerance = rng.choice([86_400, 259_200])
    alerts = [(rng.randrange(300) * DAY, rng.choice("AB"), rng.choice(["cusum", "robust_z"])) for _ in range(90)]
    events = [(k, rng.randrange(300) * DAY, rng.choice("AB"), rng.choice(["positive", "positive", "quiet"])) for k in range(30)]
    spans = {k: (ts, ts + 604_800 * NS) if p == "quiet" else (ts - tolerance * NS, ts + tolerance * NS) for k, ts, _, p in events}
    inside = [(k, p, t) for k, _, s, p in events for t, own, _ in alerts if own == s and spans[k][0] <= t <= spans[k][1]]
    hit = {k for k, _, _ in inside}
    wanted = (
        sum(p == "positive" and k in hit for k, *_, p in events), sum(p == "positive" for *_, p in events), sum(p == "quiet" for _, p, _ in inside), 7.0 * sum(p == "quiet" for *_, p in events),
        sum(not any(s == own and spans[k][0] <= t <= spans[k][1] for k, _, s, _ in events) for t, own, _ in alerts),
    )
    a = spark.createDataFrame([(t, s, k, 1.0, 5.0) for t, s, k in alerts], "ts_ns bigint, symbol string, kind string, price double, score double")
    e = spark.createDataFrame([(k, t, s, "x", p, 604_800.0 if p == "quiet" else 0.0) for k, t, s, p in events], "event_no bigint, ts_ns bigint, symbol string, event_type string, polarity string, duration_sec double")
    s = evaluate.summary(a, e, tolerance).first()
    assert (s.detected, s.positives, s.quiet_alerts, s.quiet_days, s.unattributed) == wanted


def test_wilson_and_units_of_days(spark):
    events = [(k, k * 20 * DAY, "S", "x", "positive", 0.0) for k in range(1, 11)]
    a = spark.createDataFrame([(k * 20 * DAY + (k % 2) * DAY, "S", "cusum", 1.0, 5.0) for k in range(1, 7)], "ts_ns bigint, symbol string, kind string, price double, score double")
    e = spark.createDataFrame(events, "event_no bigint, ts_ns bigint, symbol string, event_type string, polarity string, duration_sec double")
    s, t = evaluate.summary(a, e, 86_400).first(), evaluate.ttd_summary(a, e, 86_400).first()
    assert (s.detected, s.positives) == (6, 10) and (s.recall_low, s.recall_high) == pytest.approx((0.313, 0.832), abs=1e-3)
    assert (t.n, t.unit, t.resolution_ns, t.median_units) == (6, "day", DAY, 1.0)


def test_time_resolution_takes_all_tasks(spark):
    """Stamps of many partitions are folded where they lie: the plan has no step that brings all rows to one task."""
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") * 6_000 + 17).alias("ts_ns"))
    found = evaluate.time_resolution(df)
    assert found.first()[0] == 6_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "RoundRobin" not in plan
    large = spark.createDataFrame([(-(2**61),), (2**61,), (2**61 - 12,)], "ts_ns bigint")
    assert evaluate.time_resolution(large).first()[0] == 4


def test_time_resolution(spark):
    of = lambda values: evaluate.time_resolution(spark.createDataFrame([(v,) for v in values], "ts_ns bigint").repartition(3)).first()[0]
    assert of([k * DAY for k in (3, 5, 9)]) == 2 * DAY
    assert of([7 + k * 3 * 10**6 for k in range(0, 50, 2)] + [None]) == 6 * 10**6
    assert of([5]) == 0 and of([]) == 0 and of([None]) == 0 and of([4, 4]) == 0


def most_rows(found):
    """The most rows that a step of a collected plan made."""
    steps, most = [found._jdf.queryExecution().executedPlan()], 0
    while steps:
        step = steps.pop()
        made, children = step.metrics().get("numOutputRows"), step.children()
        most = max(most, made.get().value() if made.isDefined() else 0)
        steps += [children.apply(k) for k in range(children.size())]
    return most


EVENTS = "event_no bigint, ts_ns bigint, symbol string, event_type string, polarity string, duration_sec double"


@pytest.mark.parametrize("seed", range(3))
def test_time_to_detect_against_loops(spark, seed):
    """Points and spans of two symbols beside ties, repeated numbers, nulls, and the borders of hours, days and windows."""
    rng = random.Random(seed)
    tolerance = rng.choice([0, 1_800, 90_000])
    at = lambda: None if rng.random() < 0.05 else rng.randrange(-40, 40) * 1_800 * NS + rng.choice([0, 0, 1, -1])
    alerts = [(at(), rng.choice(["A", "B", None])) for _ in range(60)]
    events = [(rng.randrange(60), at(), rng.choice(["A", "B", "C", None]), "x", rng.choice(["positive", "positive", "quiet"]), rng.choice([0.0, -1.0, 1_800.0, 200_000.5, None])) for _ in range(60)]
    best = {}
    for k, t, s, _, polarity, d in events:
        if t is None or s is None or d is None or polarity != "positive":
            continue
        low, high = (t - tolerance * NS, t + tolerance * NS) if d <= 0 else (t, t + int(d * NS))
        for u, own in alerts:
            if u is not None and own == s and low <= u <= high:
                best[k] = min(best.get(k, (True, 10**30)), (u < t, abs(u - t)))
    a = spark.createDataFrame(alerts, "ts_ns bigint, symbol string")
    found = evaluate.time_to_detect(a, spark.createDataFrame(events, EVENTS), tolerance).collect()
    assert best and {r.event_no: r.ttd_ns for r in found} == {k: -gap if late else gap for k, (late, gap) in best.items()} and len(found) == len(best)


def test_time_to_detect_makes_no_pairs(spark):
    """1,000 events beside 1,000 alerts of one hour: no step makes more rows than went in."""
    n, no = 1_000, "cast(null as string)"
    alerts = spark.range(n).selectExpr("(id div 2) * 1000000000 + 5 as ts_ns", "'X' as symbol", f"{no} as kind")
    events = spark.range(n).selectExpr("id as event_no", "(id div 2) * 1000000000 as ts_ns", "'X' as symbol", f"{no} as event_type", "'positive' as polarity", "0d as duration_sec")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = evaluate.time_to_detect(alerts, events, 1_800)
        assert [r.ttd_ns for r in found.collect()] == [5] * n
        assert most_rows(found) <= 2 * n + 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_ttd_summary_takes_the_upper_median(spark):
    alerts = spark.createDataFrame([(k * DAY + d * 10**6, "X", k, "a", 1.0, 1.0) for k, d in ((1, 5), (2, -7), (3, 11), (4, 1))], "ts_ns bigint, symbol string, seq bigint, kind string, price double, score double")
    events = spark.createDataFrame([(k, k * DAY, "X", "n", "positive", 0.0) for k in range(1, 6)], "event_no bigint, ts_ns bigint, symbol string, event_type string, polarity string, duration_sec double")
    t = evaluate.ttd_summary(alerts, events, 60).first()
    assert (t.n, t.mean_ms, t.median_ms, t.early, t.earliest_ms, t.unit) == (4, 2.5, 5.0, 1, -7.0, "ms")
    none = evaluate.ttd_summary(alerts.limit(0), events, 60).first()
    assert (none.n, none.mean_ms, none.median_ms, none.early) == (0, 0.0, 0.0, 0)


def test_ttd_summary_makes_no_pairs(spark):
    """1,000 events beside 1,000 alerts of one hour: no step makes more rows than went in."""
    n, no = 1_000, "cast(null as string)"
    alerts = spark.range(n).selectExpr("(id div 2) * 1000000000 + 5 as ts_ns", "'X' as symbol", f"{no} as kind")
    events = spark.range(n).selectExpr("id as event_no", "(id div 2) * 1000000000 as ts_ns", "'X' as symbol", f"{no} as event_type", "'positive' as polarity", "0d as duration_sec")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = evaluate.ttd_summary(alerts, events, 1_800)
        t = found.collect()[0]
        assert (t.n, t.mean_ms, t.median_ms, t.early, t.resolution_ns) == (n, 5e-6, 5e-6, 0, 5)
        assert most_rows(found) <= 2 * n + 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_artifact(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts_ns,symbol,kind,price,score\n" + "".join(f"{k * DAY},X,cusum,1.0,5.0\n" for k in (1, 2, 9)))
    (tmp_path / "e.csv").write_text(f'"ts_ns","symbol","event_type","description","polarity","duration_sec"\n{DAY},X,halt,why,positive,0\n{30 * DAY},X,news,late,positive,0\n{9 * DAY},X,calm,,quiet,604800\n')
    x = json.loads(evaluate.artifact(spark, str(tmp_path / "a.csv"), str(tmp_path / "e.csv"), 3600.0).first()[0])
    assert x["inputs"]["alerts_sha256"] == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()
    assert x["inputs"]["events_sha256"] == hashlib.sha256((tmp_path / "e.csv").read_bytes()).hexdigest()
    r = x["results"]
    assert (r["detected"], r["positives"], r["quiet_alerts"], r["unattributed"], r["alerts"], r["outside_coverage"]) == (1, 2, 1, 1, 3, 1)
    assert [e["event_type"] for e in r["missed_events"]] == ["news"] and r["rate_high"] > r["rate_low"] > 0
    only = json.loads(evaluate.artifact(spark, str(tmp_path / "a.csv"), str(tmp_path / "e.csv"), 3600.0, ["burst"]).first()[0])
    assert only["results"]["alerts"] == 0 and only["results"]["detected"] == 0 and only["results"]["outside_coverage"] == 1


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def ticks(spark):
    """Three symbols with many rows, few rows, and one; equal times, and gaps of many buckets."""
    rng = np.random.default_rng(1)
    rows = []
    for symbol, n in (("hot", 400), ("thin", 25), ("one", 1)):
        ts = np.cumsum(rng.choice([0, NS, 40 * NS, 5000 * NS], n, p=[0.1, 0.5, 0.35, 0.05]))
        rows += [(symbol, int(t), k, float(p), float(o)) for k, (t, p, o) in enumerate(zip(ts, rng.uniform(1, 2, n), rng.uniform(-1, 1, n)))]
    return spark.createDataFrame(rows, "symbol string, ts_ns bigint, seq bigint, price double, obi double").repartition(5)


@pytest.mark.parametrize("bucket", [30, 3600])
def test_windows_by_time_equal_windows_by_symbol(spark, ticks, bucket):
    w = windows.by_symbol()
    own = ("symbol", "seq")
    wanted = ticks.withColumn("log_return", F.log(F.col("price") / F.lag("price").over(w)))
    got, want = ({r[:2]: r[2] for r in map(tuple, x.select(*own, "log_return").collect())} for x in (windows.log_return(ticks, bucket), wanted))
    assert got == want
    span = F.col("ts_ns") - F.lag("ts_ns", 19).over(w)
    wanted = ticks.withColumn("rate", F.when(span > 0, 20 / (span / 1e9)).otherwise(0.0))
    assert rows_of(windows.quote_rate(ticks, bucket_sec=bucket), *own, "rate") == rows_of(wanted, *own, "rate")
    wanted = ticks.withColumn("n", F.count("*").over(windows.by_symbol("ts_ns").rangeBetween(-100 * NS, 0)))
    assert rows_of(windows.within(ticks, 100, "n", bucket), *own, "n") == rows_of(wanted, *own, "n")
    new = F.when(F.col("ts_ns") - F.lag("ts_ns").over(w) > 50 * NS, 1).otherwise(0)
    wanted = ticks.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    assert rows_of(windows.sessions(ticks, 50, bucket), *own, "session") == rows_of(wanted, *own, "session")
    fired, latched = [], {}
    for r in sorted(ticks.collect(), key=lambda r: (r.symbol, r.ts_ns, r.seq)):
        if abs(r.obi) > 0.9 and not latched.get(r.symbol):
            latched[r.symbol] = True
            fired.append((r.symbol, r.seq))
        elif abs(r.obi) < 0.5:
            latched[r.symbol] = False
    assert rows_of(windows.hysteresis(ticks, "obi", 0.9, 0.5, bucket), *own) == sorted(fired) and fired


def test_values_at_ranks(spark, ticks):
    rows = ticks.unionByName(ticks.limit(0)).union(spark.createDataFrame([("ties", 0, k, 7.0, None) for k in range(99)] + [("null", 0, 0, None, None)], ticks.schema))
    got = {r.symbol: (r.low, r.mid, r.far) for r in windows.at_ranks(rows, ["symbol"], "price", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "far": F.col("n") + 5}).collect()}
    by = {}
    for r in rows.where("price is not null").collect():
        by.setdefault(r.symbol, []).append(r.price)
    assert got == {s: (min(v), sorted(v)[len(v) // 2], None) for s, v in by.items()}
    assert windows.at_ranks(rows, [], "price", {"mid": F.floor(F.col("n") / 2)}).first().mid == sorted(x for v in by.values() for x in v)[sum(map(len, by.values())) // 2]


def test_ranks_among_equal_values(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 10 < 8, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = windows.at_ranks(rows, ["k"], "v", {f"r{r}": F.lit(r) for r in (0, 1199, 1200, 1499, 1500)})
    for r in got.collect():
        v = sorted(x.v for x in rows.where(F.col("k") == r.k).collect())
        assert [r.r0, r.r1199, r.r1200, r.r1499, r.r1500] == [v[0], v[1199], v[1200], v[1499], None]


def test_percentiles(spark, ticks):
    got = {r.symbol: (r.a, r.b) for r in windows.percentiles(ticks, ["symbol"], "price", {"a": 0.25, "b": 0.999}).collect()}
    by = {}
    for r in ticks.collect():
        by.setdefault(r.symbol, []).append(r.price)
    assert got.keys() == by.keys() and all(got[s] == pytest.approx(np.quantile(v, [0.25, 0.999])) for s, v in by.items())


def test_quiet_starts(spark):
    rng = np.random.default_rng(2)
    z, vol = rng.normal(size=300), np.r_[[None] * 19, rng.uniform(1, 2, 281)]
    days = spark.createDataFrame([(k, float(a), None if v is None else float(v)) for k, (a, v) in enumerate(zip(z, vol))], "t int, z double, vol double")
    known = [float(v) for v in vol if v is not None]
    wanted = []
    for s in range(300 - 9):
        inside = [float(v) for v in vol[s : s + 10] if v is not None]
        if np.abs(z[s : s + 10]).max() < 2 and inside and np.median(inside) < np.median(known) and (not wanted or s >= wanted[-1] + 10):
            wanted.append(s)
    got = sorted(r.start for r in windows.quiet_starts(days, "t", "z", "vol", days=10).collect())
    assert got == wanted[:3] and len(got) == 3
    assert windows.quiet_starts(days.where("t < 5"), "t", "z", "vol", days=10).count() == 0


def runs(spark, crisis, quiet):
    """Peaks of gaussian, t and two trains by event."""
    rows = [(f"{kind} {k}", kind, m, z, day) for kind, events in (("crisis", crisis), ("quiet", quiet)) for k, own in enumerate(events) for m, (z, day) in zip(("gaussian", "t", "mps_a", "mps_b"), own)]
    return spark.createDataFrame(rows, "event string, type string, method string, peak_z double, peak_day int")


def test_gate_decisions(spark):
    """By hand: the best train is the farther one; it must be half as far again as the gaussian on two events."""
    far = [(-2.0, 3), (-3.0, 3), (-1.0, 9), (-4.0, 5)]
    near = [(-2.0, 3), (-3.0, 3), (-2.9, 9), (2.8, 1)]
    calm, loud = [(-0.5, 1), (-0.6, 1), (-0.7, 1), (0.8, 1)], [(-0.5, 1), (-0.6, 1), (-9.0, 1), (0.8, 1)]
    v = gates.verdict(runs(spark, [far, far, near], [calm, calm, loud])).first()
    assert (v.n_far, v.n_timely, v.n_beyond_t, v.n_spurious, v.n_spurious_t, v.threshold) == (2, 2, 2, 1, 0, 4.0)
    assert (v.c1, v.c2, v.c3, v.c4, v.c5, v.decision) == (True, True, True, True, False, "fail")
    assert gates.verdict(runs(spark, [far, far, near], [calm, calm, calm])).first().decision == "full"
    late = [*far[:3], (-4.0, 6)]
    assert gates.verdict(runs(spark, [late, late, near], [calm])).first().decision == "partial"
    assert gates.verdict(runs(spark, [near, near, far], [calm])).first().decision == "fail"


@pytest.mark.parametrize("row,wanted", [
    ((False, True, 1.0, 999.0, None), "down"), ((None, True, 1.0, 999.0, None), "down"), ((True, False, None, 5.0, None), "reconnecting"), ((True, None, None, 5.0, None), "starting"),
    ((True, True, None, 60.0, None), "degraded"), ((True, True, None, 90.0, 300.0), "starting"), ((True, None, 30.0, 5.0, None), "ok"), ((True, True, 30.1, 5.0, None), "degraded"),
])
def test_health(spark, row, wanted):
    df = spark.createDataFrame([row], "alive boolean, connected boolean, age double, up double, stale double")
    assert df.select(control.health(*map(F.col, df.columns))).first()[0] == wanted


def test_watchlists(spark):
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "symbol string")
    have = of("AAA", "BBB")
    changes = lambda want, **k: rows_of(control.reconcile(want, have, **k), "change", "symbol")
    assert changes(of(" bbb", "ccc", "ccc ", None, "")) == [("add", "CCC"), ("remove", "AAA")]
    assert changes(of("aaa", "bbb")) == [] and changes(of()) == [] and changes(of(" ", None)) == []
    assert changes(of(), allow_empty=True) == [("remove", "AAA"), ("remove", "BBB")]


def test_settings(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "name string, value string")
    out = control.overlay(of(("a", "1"), ("b", "2"), ("c", "3"), ("d", None)), of(("a", "9"), ("b", "2"), ("x", "0")), of(("c", None), ("a", "7"), ("d", "4")))
    assert rows_of(out, "name", "value", "overridden") == [("a", "7", True), ("b", "2", False), ("c", "3", False), ("d", "4", True)]


def test_pauses(spark):
    events = spark.createDataFrame([(k * NS, k) for k in range(0, 400_000, 7000)], "ts_ns bigint, seq bigint")
    switches = [(20_000, False), (30_000, False), (90_000, True), (100_000, True), (210_000, False), (217_000, True), (350_000, False)]
    on = lambda k: next((a for t, a in reversed(switches) if t <= k), True)
    got = rows_of(control.while_active(events, spark.createDataFrame([(t * NS, a) for t, a in switches], "ts_ns bigint, active boolean")), "seq")
    assert got == [(k,) for k in range(0, 400_000, 7000) if on(k)]
    assert control.while_active(events, spark.createDataFrame([], "ts_ns bigint, active boolean")).count() == events.count()
    table = spark.createDataFrame([(t * NS, a) for t, a in [*switches, (90_000, False), (130_000, None)]], "ts_ns bigint, active boolean")
    for bucket in (1_000, 100_000, 10_000_000):  # of two switches at one time the one that turns on holds; a null is none
        assert rows_of(control.while_active(events, table, bucket), "seq") == got


def test_dependence_shift(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.6, 0.4], [0, 0.8, 0.3], [0, 0, 0.9]])
    x[-5:] *= np.array([4, -4, 4])
    df = spark.createDataFrame([(k + 1, *map(float, r)) for k, r in enumerate(x)], "t bigint, a double, b double, c double")
    r = models.dependence_shift(df, ["a", "b", "c"], ref=100).first()
    ref = x[-115:][:100]
    model = models.TCopula(ref)
    null = np.convolve(model.log_likelihood(ref), np.ones(5), "valid")
    own = model.log_likelihood(x[-5:]).sum()
    assert (r.symbol, r.t, r.df, r.alert) == ("a,b,c", 300, model.df, True)
    assert (r.price, r.score) == pytest.approx((own, (own - null.mean()) / null.std(ddof=1)))
    assert models.dependence_shift(df.where("t < 50"), ["a", "b", "c"], ref=100).count() == 0


def test_degrees_of_freedom_by_average_ranks():
    """Ties: average ranks and the empirical distribution differ, and the copula is fitted by the first."""
    x = np.round(np.random.default_rng(6).standard_t(3, size=(120, 3)), 0)
    model = models.TCopula(x)
    u = models.average_uniform(x)
    k = [sorted(x[:, 0].tolist()).index(v) for v in x[:, 0]]
    assert u[:, 0] == pytest.approx([(k[i] + 1 + (np.sum(x[:, 0] == v) - 1) / 2) / 121 for i, v in enumerate(x[:, 0])])
    assert not np.allclose(u, model.uniform(x))
    assert model.df == max(models.DEGREES, key=lambda df: (model.density(u, df).sum(), -df))
    gauss = models.TCopula(x, gaussian=True)
    assert gauss.df is None and np.isfinite(gauss.log_likelihood(x)).all()


def test_nearest_positive():
    fixed = models.nearest_positive(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))
    assert np.diag(fixed) == pytest.approx([1, 1, 1]) and np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(fixed, fixed.T)


def test_tau_by_blocks(spark):
    x = np.random.default_rng(7).integers(0, 5, size=(25, 2)).astype(float)
    df = spark.createDataFrame([(k + 1, *map(float, r)) for k, r in enumerate(x)], "t bigint, a double, b double")
    got = {r.block: r.tau for r in models.kendall_tau(df, "t", ["a", "b"], 10).collect()}
    for block in range(3):
        part = x[block * 10 : block * 10 + 10]
        s = [(np.sign(p[0] - q[0]), np.sign(p[1] - q[1])) for i, p in enumerate(part) for q in part[i + 1 :]]
        assert got[block] == pytest.approx(sum(a * b for a, b in s) / math.sqrt(sum(a * a for a, _ in s) * sum(b * b for _, b in s)))


def test_sinks_and_their_readers(spark, tmp_path):
    rows = [("X", k * NS, k, 0, "cusum" if k % 2 else "robust_z", 1.0, float(k), '{"cusum_h": 5.0, "z_threshold": 4.0}') for k in range(10)]
    batch = spark.createDataFrame(rows, ALERTS)
    sink = live.table_sink(str(tmp_path / "t"))
    sink(batch, 0)
    sink(batch, 0)  # a batch that runs again replaces what it wrote
    sink(batch.where("seq > 7").withColumn("ts_ns", F.col("ts_ns") + 100 * NS), 1)
    history = live.alert_history(spark, str(tmp_path / "t"), symbol="X", kind="cusum", since=NS, limit=3)
    assert [(r.ts_ns // NS, r.severity) for r in history.collect()] == [(109, "ANOMALY"), (9, "ANOMALY"), (7, "WARNING")]
    assert history.first().narrative == "ANOMALY: Cumulative drift +9.00 on X (CUSUM threshold ±5.0)"
    assert live.alert_history(spark, str(tmp_path / "t"), until=3 * NS).count() == 4
    files.write_alerts_csv(batch, str(tmp_path / "a"))
    assert rows_of(files.alerts_csv(spark, str(tmp_path / "a")), "ts_ns", "kind", "score") == sorted((r[1], r[4], r[6]) for r in rows)
    events = spark.createDataFrame([("X", NS, 1, "t", 1.5), ("X", 2 * NS, 2, "q", None), ("Y", 3 * NS, 3, "t", 2.0)], "symbol string, ts_ns bigint, seq bigint, etype string, price double")
    live.recorder_sink(str(tmp_path / "r"))(events, 0)
    recorded = str(tmp_path / "r" / "batch=0")
    assert rows_of(files.ticks_csv(spark, recorded), "symbol", "ts_ns", "price") == [("X", NS, 1.5), ("Y", 3 * NS, 2.0)]
    assert rows_of(files.ticks_csv(spark, recorded, "Y"), "symbol") == [("Y",)]
    stream = files.replay(spark, recorded).writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("replayed").count() == 2
    assert files.feed_path("crypto") == "/v1beta3/crypto/us" and files.feed_path("other") == "/v2/other"


def test_digests(spark):
    rng = np.random.default_rng(8)
    rows = [(s, int(t) * NS, 0, 0, "cusum", 1.0, float(x), None) for s in "AB" for t, x in zip(np.sort(rng.integers(0, 8000, 80)), rng.uniform(-9, 9, 80))]
    sent, wanted = {}, {}
    for s, ts, *_, score, _ in sorted(rows):
        w = ts // (60 * NS)
        if abs(score) >= 6 and (s not in sent or w == sent[s] or ts - (sent[s] + 1) * 60 * NS >= 900 * NS):
            sent[s] = w
            wanted.setdefault(w, []).append(s)
    got = live.digests(spark.createDataFrame(rows, ALERTS))
    assert rows_of(got, "w", "n", "names") == sorted((w, len(x), ", ".join(sorted(set(x)))) for w, x in wanted.items())


def test_webhook_bodies(spark):
    rows = [("X", k * NS // 2, k, 0, "cusum", 1.0, float(k), None) for k in range(6)]
    got = live.webhook_bodies(spark.createDataFrame(rows, ALERTS), "iex", 2.0).orderBy("w").collect()
    body = json.loads(got[0].body)
    assert [(r.w, r.n) for r in got] == [(1, 2), (2, 2)]
    assert (body["source"], body["feed"], body["asset_class"]) == ("driftwatch", "iex", "equities")
    assert [a["score"] for a in body["alerts"]] == [2.0, 3.0]


def test_detectors_over_a_stream_of_messages(spark, tmp_path):
    """A jump of five per cent among trades that come in as a feed's messages, two files one after the other."""
    (tmp_path / "in").mkdir()
    price, lines = 100.0, []
    for i in range(300):
        price *= 1.05 if i == 250 else 1.0001
        lines.append(json.dumps([{"T": "t", "S": "X", "p": price, "s": "no number", "t": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.5Z"}, {"T": "error", "code": 402}]))
    for k in (0, 1):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(["junk", *lines[k * 150 : k * 150 + 150]]))
    alerts = live.detect_stream(files.message_stream(spark, str(tmp_path / "in")))
    stream = alerts.writeStream.format("memory").queryName("jumps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination()
    found = spark.table("jumps").where("kind = 'robust_z'").collect()
    assert any(r.ts_ns == 1_704_067_200_500_000_000 + 250 * NS and r.score > 4 for r in found)
