"""Column expressions by example, and what ships the package."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

import driftwatch
from driftwatch.functions import scalar as S
from driftwatch.operators.kernels import LIBRARY, LIVE, Returns

SENTENCES = [
    ("robust_z", 4.5, {"z_threshold": 4.0}, "ALERT: Price deviation +4.50σ from baseline on X (threshold ±4.0)"),
    ("robust_z", -8.0, {}, "ANOMALY: Price deviation -8.00σ from baseline on X (threshold ±?)"),
    ("cusum", 5.25, {"cusum_h": 5.0}, "WARNING: Cumulative drift +5.25 on X (CUSUM threshold ±5.0)"),
    ("spread_widen", 6.0, {"spread_bps": 12.34, "baseline_bps": 3.0}, "WARNING: Spread 12.3bps on X, +6.00σ from baseline 3.0bps"),
    ("spread_widen", 6.0, {}, "WARNING: Spread 0bps on X, +6.00σ from baseline 0bps"),
    ("obi_extreme", -0.954, {"side": "ask"}, "ALERT: Order book 95% ask-dominant on X"),
    ("quote_rate_spike", 5.5, {"rate_qps": 40.0, "baseline_qps": 2.5}, "WARNING: Quote rate 40.0/s on X, +5.50σ from baseline 2.5/s"),
    ("regime_shift", 0.31, {"ks_statistic": 0.31, "ks_threshold": 0.25}, "INFO: Return distribution shifted on X (KS=0.310, threshold 0.25)"),
    ("regime_shift", 0.5, {}, "INFO: Return distribution shifted on X (KS=0.500, threshold ?)"),
    ("burst", 3.5, {"alerts_in_window": 7, "window_sec": 10.0, "intensity_ratio": 3.5}, "WARNING: Alert clustering on X - 7 alerts in 10s (3.5× baseline)"),
    ("dependence_shift", -3.2, None, "ALERT: Cross-asset dependence shifted -3.20σ across the basket"),
    ("volume_spike", 4.1, {"size": 1234567.0, "ratio_to_baseline": 55.5}, "ALERT: Volume spike on X, trade size 1.235e+06 (55.5× rolling mean)"),
    ("microprice_drift", 4.4, {"side": "bid"}, "ALERT: Microprice drift +4.40σ toward bid on X (informational asymmetry)"),
    ("crossed_book", 0.5, {"bid": 10.5, "ask": 10.0}, "ANOMALY: Crossed book on X - bid 10.5000 > ask 10.0000 (data error or extreme stress)"),
    ("other", 1.0, None, "INFO: other on X (score +1.00)"),
]


def test_narratives(spark):
    rows = [(k, "X", score, None if details is None else json.dumps(details), text) for k, score, details, text in SENTENCES]
    df = spark.createDataFrame(rows, "kind string, symbol string, score double, details string, wanted string")
    for r in df.withColumn("got", S.narrative()).collect():
        assert r.got == r.wanted


def test_narratives_without_numbers(spark):
    rows = [("burst", "X", 4.0, None), ("cusum", "X", 5.5, '{"cusum_h": "high"}'), ("cusum", None, 5.5, None), (None, "X", 1.0, None), ("other", "X", float("nan"), None), ("other", "X", None, None), ("other", "a|{b}'", 1.0, "no json")]
    got = [r[0] for r in spark.createDataFrame(rows, "kind string, symbol string, score double, details string").coalesce(1).select(S.narrative()).collect()]
    assert got == ["WARNING: Alert clustering on X - ? alerts in ?s (4.0× baseline)", "WARNING: Cumulative drift +5.50 on X (CUSUM threshold ±?)", None, None, None, None, "INFO: other on a|{b}' (score +1.00)"]
    assert spark.createDataFrame([], "kind string, symbol string, score double, details string").select(S.narrative()).collect() == []


def test_numbers_for_people(spark):
    values = [None, 0.0, 1.005, -2.5, 0.00012345, 1e6, 12345678.9, 999999.994]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(S.fmt(F.col("v"))).collect()] == ["-", "0.00", "1.00", "-2.50", "0.00012", "1e+06", "1.2e+07", "999999.99"]


def test_severity_bounds(spark):
    df = spark.createDataFrame([("a", x) for x in (2.99, 3.0, 4.99, -5.0, 7.99, -8.0)], "kind string, score double")
    assert [r[0] for r in df.select(S.severity()).collect()] == ["INFO", "ALERT", "ALERT", "WARNING", "WARNING", "ANOMALY"]


def test_names_and_times(spark):
    df = spark.createDataFrame([("crypto", " btc/usd "), ("iex", "spy"), ("sip", "x"), ("else", "")], "feed string, raw string")
    got = df.select(S.asset_class(F.col("feed")), S.normal_symbol(F.col("raw"))).collect()
    assert [tuple(r) for r in got] == [("crypto", "BTC/USD"), ("equities", "SPY"), ("equities", "X"), ("unknown", "")]
    times = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.1Z", "2024-01-01T00:00:00.123456789Z"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(S.rfc3339_ns(F.col("t"))).collect()
    assert [r[0] - 1_704_067_200_000_000_000 for r in got] == [0, 100_000_000, 123_456_789]


def test_books(spark):
    df = spark.createDataFrame([(10.0, 11.0, 3.0, 1.0), (11.0, 10.0, 1.0, 1.0), (0.0, 4.0, 0.0, 1.0), (None, 1.0, 1.0, 1.0)], "bid double, ask double, bid_size double, ask_size double")
    got = df.select(S.mid(), S.spread_bps(), S.imbalance(), S.microprice_drift()).collect()
    assert got[0][:] == (10.5, pytest.approx(1e4 / 10.5), 0.5, pytest.approx(0.25))
    assert got[1][:] == (10.5, 0.0, 0.0, None) and got[2][:] == (2.0, 0.0, None, None)


def test_profiles():
    """A live session warms up longer, and nothing is scored before 100 returns."""
    import numpy as np

    price, ts = 100 + np.arange(150) % 3.0, np.arange(150) * 10**9
    first = lambda p: int(np.flatnonzero(Returns(p).add(price, ts)["scored"])[0])
    assert (first(LIBRARY), first(LIVE)) == (5, 100)


def test_shipping(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(zipfile.ZipFile(path).namelist()))
    driftwatch.ship(spark)
    assert "driftwatch/operators/detect.py" in sent[0]
