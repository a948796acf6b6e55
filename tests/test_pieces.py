"""Hot symbols in pieces against the same folds over whole symbols, row for row."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.operators import detect as D
from driftwatch.operators import pieces
from driftwatch.operators.kernels import KINDS, MARKED, Params

P = Params(alpha=0.1, burst_alpha=0.05, regime_ref=40, regime_stride=10, regime_short=50, regime_ks=0.3, regime_cooldown=30.0, z_thresh=3.0, cusum_h=4.0, spread_z=2.0, vol_z=2.0, micro_z=2.0, burst_k=1.5, burst_window=60.0, burst_cooldown=40.0)
WHOLE = 10**9


def stream(spark, n=12_000, seed=1, quiet=False):
    """A hot symbol, a middling and a rare one; gaps, prices that aren't positive, missing values, equal times."""
    rng = np.random.default_rng(seed)
    symbol = rng.choice(["hot", "warm", "cold"], n, p=[0.8, 0.19, 0.01])
    ts = np.cumsum(rng.choice([0, 10**8, 10**9, 5 * 10**9, 700 * 10**9], n, p=[0.2, 0.3, 0.4, 0.099, 0.001]))
    is_quote = rng.random(n) < 0.5
    step = np.where(rng.random(n) < 0.02, 0.02, 0.0005) * rng.standard_normal(n) * np.where(np.arange(n) % 3000 < 1500, 1, 6)
    price = 100 * np.exp(np.cumsum(0 * step if quiet else step) * 0.2)
    price[rng.random(n) < 0.001] = 0.0
    half = price * rng.integers(-1, 9, n) / 10_000
    size = lambda: np.round(np.exp(rng.standard_normal(n) * 1.5)) * (rng.random(n) > 0.02)
    trade, quote = ~is_quote & (rng.random(n) > 0.01), is_quote & (rng.random(n) > 0.01)
    some = lambda where, x: [float(v) if w else None for w, v in zip(where, x)]
    columns = [symbol.tolist(), ts.tolist(), list(range(n)), np.where(is_quote, "q", "t").tolist()]
    columns += [some(trade, price), some(trade, size()), some(quote, price - half), some(quote, price + half), some(quote, size()), some(quote, size())]
    schema = "symbol string, ts_ns bigint, seq bigint, etype string, price double, size double, bid double, ask double, bid_size double, ask_size double"
    return spark.createDataFrame(list(zip(*columns)), schema)


def held(got, wanted):
    a, b = sorted(map(tuple, got.collect()), key=repr), sorted(map(tuple, wanted.collect()), key=repr)
    assert a == b and len(b) > 10
    return b


@pytest.fixture(scope="module")
def events(spark):
    return stream(spark).persist()


@pytest.mark.parametrize("params", [P, replace(P, min_obs=300, warmup=30), replace(P, use_quote_mid=False, session_gap=4.0)])
def test_all_kinds(spark, events, params):
    found = held(D.detect(events, params, {"warm": 2.0}, piece_rows=900), D.detect(events, params, {"warm": 2.0}, piece_rows=WHOLE))
    if params is P:
        assert {r[4] for r in found} == set(KINDS)


@pytest.mark.parametrize("kind", [*sorted(set(KINDS) - MARKED), "spread_widen"])
def test_kinds_by_themselves(events, kind):
    held(D.detect(events, P, kinds=[kind], piece_rows=700), D.detect(events, P, kinds=[kind], piece_rows=WHOLE))


def test_scores_and_sweeps(events):
    ticks = events.where("etype = 't' and price > 0")
    held(D.price_scores(ticks, P, piece_rows=500), D.price_scores(ticks, P, piece_rows=WHOLE))
    held(D.ewma_scores(ticks, "size", replace(P, min_obs=50), piece_rows=500), D.ewma_scores(ticks, "size", replace(P, min_obs=50), piece_rows=WHOLE))
    one, whole = (sorted(map(tuple, D.sweep(ticks, [2.0, 3.0], [3.0, 5.0], P, piece_rows=k).collect())) for k in (500, WHOLE))
    assert one == whole and len(whole) == 4


def test_pieces_that_guess_wrong_run_again(spark, events, monkeypatch):
    """Without a lead, and with values on which two starts never meet: rounds of second runs, the same rows."""
    rounds = []
    inner = pieces._folded
    monkeypatch.setattr(pieces, "_folded", lambda dealt, tasks, fresh, schema, entries: rounds.append(len(entries)) or inner(dealt, tasks, fresh, schema, entries))
    ticks = D.from_ticks(events.where("etype = 't' and price > 0"))
    monkeypatch.setattr(D, "remembered", lambda params: 0)
    held(D.detect(ticks, P, kinds=["cusum", "robust_z"], piece_rows=600), D.detect(ticks, P, kinds=["cusum", "robust_z"], piece_rows=WHOLE))
    assert rounds[0] == 0 and rounds[1] >= 5 and len(rounds) <= 4
    rounds.clear()
    still = events.where("etype = 't' and price > 0").withColumn("price", F.when(F.col("seq") < 2000, F.col("price")).otherwise(50.0))
    held(D.price_scores(still, P, piece_rows=400), D.price_scores(still, P, piece_rows=WHOLE))
    assert len(rounds) > 2


def test_cut_gives_each_piece_its_lead(spark):
    rng = np.random.default_rng(3)
    times = np.sort(np.r_[rng.integers(0, 10**6, 3000), np.full(700, 5 * 10**5), rng.integers(9 * 10**17, 9 * 10**17 + 10**4, 500)])
    rows = spark.createDataFrame([("a", int(t), k) for k, t in enumerate(times)] + [("b", 5, 1)], "symbol string, ts_ns bigint, seq bigint")
    assert pieces.cut(rows, 3000, 10) is None
    dealt = pieces.cut(rows, 400, 150).rows.collect()
    assert sorted((r.symbol, r.seq) for r in dealt if r["_own"]) == sorted((r.symbol, r.seq) for r in rows.collect())
    by = {}
    for r in dealt:
        by.setdefault((r.symbol, r["_piece"]), ([], []))[r["_own"]].append((r.ts_ns, r.seq))
    last = -1
    for (symbol, piece), (lead, own) in sorted(by.items()):
        if symbol == "a" and own:
            own.sort()
            assert own[0][1] == last + 1
            assert sorted(k for _, k in lead) == list(range(last + 1 - len(lead), last + 1)) and len(lead) >= min(150, last + 1)
            last = own[-1][1]
    assert last == len(times) - 1
