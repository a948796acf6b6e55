import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.operators import detect, evaluate, models, pieces
from driftwatch.operators import kernels as K
from driftwatch.operators.kernels import LIBRARY, Params, ks_distance
from driftwatch.plans import queries
from driftwatch.schemas import ALERT
from driftwatch.sources import files, views
from driftwatch.streaming import live
from tests.plain_detector import P2, Ewma, Symbol

SF = "/root/testdata/sf0.001"


def random_events(rng, n, symbols=1):
    """Trades and quotes with ties, gaps, prices that aren't known or positive, crossed and one-sided books."""
    ts = np.cumsum(rng.choice([0, 10**7, 10**9, 3 * 10**9, 10**12], n, p=[0.2, 0.4, 0.3, 0.09, 0.01]))
    mid = 100 * np.exp(np.cumsum(rng.standard_t(2, n) * 1e-3))
    pick = lambda x, *odd: np.where(rng.random(n) < 0.01, rng.choice(odd, n), x)
    half = mid * rng.gamma(1.0, 1e-4, n)
    cross = np.where(rng.random(n) < 0.02, -1, 1)
    sizes = lambda: pick(np.round(rng.lognormal(3, 1.5, n)), 0.0, np.nan, -1.0)
    return rng.random(n) < 0.6, ts, pick(mid, np.nan, 0.0, -1.0), sizes(), pick(mid - half * cross, np.nan, 0.0), pick(mid + half * cross, np.nan, 0.0), sizes(), sizes()


@pytest.mark.parametrize("seed", range(6))
def test_arrays_give_what_single_events_give(seed):
    """All kinds of alerts, whatever the cuts between arrays; and kinds on their own."""
    rng = np.random.default_rng(seed)
    p = Params(session_gap=100.0, warmup=seed, min_obs=10 * (seed % 3), spread_z=2.0, qrate_z=1.5, vol_z=1.5, micro_z=1.5, z_thresh=2.0, cusum_h=3.0, burst_k=1.5, burst_window=3.0, regime_short=20, regime_ref=12, regime_stride=5, regime_check=7, regime_ks=0.2, regime_cooldown=20.0, use_quote_mid=seed % 2 == 0, p2_fallback="parity" if seed < 4 else "published")
    events = random_events(rng, 3000)
    plain, wanted = Symbol(p), []
    for i, row in enumerate(zip(*(x.tolist() for x in events))):
        wanted += [(i, *a) for a in plain.on_event(*row)]
    cuts = np.sort(rng.integers(0, 3000, 40))
    for kinds in (None, {"robust_z"}, {"spread_widen", "quote_rate_spike"}, {"burst"}, {"regime_shift", "obi_extreme"}):
        state, got = K.Symbol(p, kinds), []
        for a, b in zip([0, *cuts], [*cuts, 3000]):
            got += [(a + i, kind, price, score, details) for i, _, kind, price, score, details in state.run(*(x[a:b] for x in events))]
        own = [w for w in wanted if kinds is None or w[1] in kinds]
        assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in own]
        for g, w in zip(got, own):
            assert g[2:4] == pytest.approx(w[2:4], rel=1e-7, abs=1e-9)
            assert g[4].keys() == w[4].keys() and all(g[4][k] == (w[4][k] if isinstance(w[4][k], str) else pytest.approx(w[4][k], rel=1e-7, abs=1e-9)) for k in g[4])
    if seed == 0:
        assert {w[1] for w in wanted} == set(K.KINDS)


def test_a_jump_alerts():
    s, price, kinds = Symbol(), 100.0, []
    for i in range(300):
        price *= 1.05 if i == 250 else 1.0001
        kinds += [a[0] for a in s.on_tick(price, i * 10**9)]
    assert "robust_z" in kinds


def test_the_sixth_tick_of_a_session_is_scored_first():
    s = Symbol()
    scored = [s._score(100 + k % 2, k * 10**9) is not None for k in range(8)]
    assert scored == [False] * 5 + [True] * 3
    assert s._score(100, 10**13) is None and s.warm == 5


def test_cusum_resets_only_the_side_that_fired():
    s = Symbol(Params(cusum_k=0.5, cusum_h=2.0))
    assert [s._cusum(z) for z in (1.5, 1.5, 1.5)] == [0, 0, 3.0]
    assert s.up == 0.0 and s.down == 0.0
    assert s._cusum(-4.0) == -3.5 and s.down == 0.0


def test_p2_is_near_the_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    for p in (0.25, 0.5, 0.75):
        q = P2(p)
        assert q.value == 0.0
        for v in x:
            q.add(v)
        assert q.value == pytest.approx(np.quantile(x, p), abs=0.05)


def test_ewma_of_a_constant_has_no_deviation():
    e = Ewma(0.02, True)
    for _ in range(10):
        e.add(3.0)
    assert e.mean == 3.0 and e.mad == 0.0 and e.z(5.0) == 0.0


def test_ks():
    assert ks_distance([], [1]) == 0 and ks_distance([1, 2], [3, 4]) == 1 and ks_distance([1, 2], [1, 2]) == 0


def test_streams_give_what_tables_give(spark, tmp_path):
    events = views.event_stream(spark, SF)
    wanted = sorted(map(tuple, detect.detect(events, queries.PARAMS).collect()))
    ordered = events.withColumn("b", F.ntile(3).over(views.Window.orderBy("ts_ns", "seq")))
    for k in (1, 2, 3):
        ordered.where(F.col("b") == k).drop("b").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.detect_stream(stream, queries.PARAMS).writeStream.foreachBatch(live.fan_out(live.table_sink(str(tmp_path / "out")))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    columns = [part.split()[0] for part in ALERT.split(", ")]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    assert got == wanted and wanted


def test_partitioning_changes_nothing(spark):
    events = views.event_stream(spark, SF)
    a, b = (sorted(map(tuple, detect.detect(events.repartition(n), queries.PARAMS).collect())) for n in (1, 7))
    assert a == b


def test_published_evaluations(spark):
    """Six alerts by hand: counts of detected events, quiet hits and rows without an event."""
    day = 86_400 * 10**9
    alerts = spark.createDataFrame([(k * day, "X", kind, 1.0, 5.0) for k, kind in ((10, "a"), (10, "b"), (12, "a"), (30, "a"), (30, "a"), (50, "b"))], "ts_ns bigint, symbol string, kind string, price double, score double")
    events = spark.createDataFrame([(1, 10 * day, "X", "n", "positive", 0.0), (2, 20 * day, "X", "n", "positive", 0.0), (3, 29 * day, "X", "q", "quiet", 604800.0), (4, 11 * day, "Y", "n", "positive", 0.0)], "event_no bigint, ts_ns bigint, symbol string, event_type string, polarity string, duration_sec double")
    s = evaluate.summary(alerts, events, 86_400).first()
    assert (s.detected, s.positives, s.quiet_alerts, s.quiet_days, s.unattributed, s.alerts) == (1, 3, 2, 7.0, 2, 6)


def test_poisson_intervals(spark):
    assert models.poisson_interval(2, 42) == pytest.approx((0.00577, 0.17202), abs=1e-4)
    assert models.poisson_interval(0, 42) == pytest.approx((0, 0.0878), abs=1e-4)
    row = models.poisson_intervals(spark.createDataFrame([(4, 63.0)], "k int, t double"), "k", "t").first()
    assert (row.rate_low, row.rate_high) == pytest.approx((0.0173, 0.1626), abs=1e-3)


def test_t_quantiles():
    for df, q in ((3, 3.1824), (5, 2.5706), (10, 2.2281), (20, 2.0860)):
        assert models.t_ppf(np.array([0.975, 0.5]), df) == pytest.approx([q, 0], abs=1e-4)


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ts_ns,symbol,event_type,description\n5,X,halt,why\n")
    assert files.catalog_csv(spark, str(tmp_path / "c.csv")).first()[:] == (5, "X", "halt", "why", "positive", 0.0)
    (tmp_path / "bad.csv").write_text("ts_ns,symbol,colour\n5,X,red\n")
    with pytest.raises(ValueError):
        files.catalog_csv(spark, str(tmp_path / "bad.csv"))
    line = json.dumps([{"T": "t", "S": "X", "p": 1.5, "s": 2.0, "t": "2024-01-01T00:00:00.123456789Z"}, {"T": "error", "code": 1}])
    rows = files.messages(spark.createDataFrame([(line,), ("junk",)], "value string")).collect()
    assert [(r.symbol, r.ts_ns, r.price) for r in rows] == [("X", 1704067200123456789, 1.5)]
    t = files.synthetic_ticks(spark, ["A", "B"], 1000)
    assert t.count() == 1000 and math.isfinite(t.agg(F.sum("price")).first()[0])


def test_overrides_change_a_symbols_threshold(spark):
    ticks = detect.from_ticks(views.ticks(spark, SF))
    low = detect.detect(ticks, queries.PARAMS, {"click": 1.0}).where("kind = 'robust_z' and symbol = 'click'").count()
    assert low > detect.detect(ticks, queries.PARAMS).where("kind = 'robust_z' and symbol = 'click'").count()
    assert LIBRARY.z_thresh == 4.0


def test_pieces_of_a_hot_symbol_give_what_the_whole_gives(spark, monkeypatch):
    """Scores of a symbol of 12,000 ticks cut into pieces by time, beside one of few."""
    rng = np.random.default_rng(3)
    ts = np.cumsum(rng.choice([0, 10**9, 700 * 10**9], 12_000, p=[0.1, 0.89, 0.01]))
    rows = [("hot", int(t), k, float(p)) for k, (t, p) in enumerate(zip(ts, 100 * np.exp(np.cumsum(rng.standard_t(2, 12_000) * 1e-3))))]
    ticks = spark.createDataFrame(rows + [("thin", int(t), k, 5.0 + k % 3) for k, t in enumerate(ts[:50])], "symbol string, ts_ns bigint, seq bigint, price double").repartition(4)
    p = Params(alpha=0.1)
    assert pieces.cut(ticks, detect.PIECE_ROWS, 1000) is None
    read = lambda df: {(r.symbol, r.seq): r[3:] for r in df.collect()}
    whole = read(detect.price_scores(ticks, p)), read(detect.ewma_scores(ticks, "price", p)), read(detect.robust_z_alerts(ticks, p))
    monkeypatch.setattr(detect, "PIECE_ROWS", 1000)
    dealt = pieces.cut(ticks, 1000, detect.remembered(p)).rows
    assert dealt.where("symbol = 'hot' and _own").select("_piece").distinct().count() > 5 and dealt.where("_own").count() == ticks.count()
    assert whole == (read(detect.price_scores(ticks, p)), read(detect.ewma_scores(ticks, "price", p)), read(detect.robust_z_alerts(ticks, p)))
    assert all(whole)
