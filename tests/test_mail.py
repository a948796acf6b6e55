"""Digests against a sender that wakes minute by minute, and the detectors' table function against detect."""

import random

import pytest
from tests.test_pieces import P, stream

from driftwatch.operators import detect as D
from driftwatch.operators.table_function import register_detectors
from driftwatch.streaming import mail

NS = 10**9
SCHEMA = "symbol string, ts_ns bigint, seq bigint, ord int, kind string, price double, score double, details string"


def sender(alerts, window, min_score, cooldown):
    """The sender's life as events on a clock: alerts, and the end of each wait."""
    out, batch, sent, since = {}, [], {}, None

    def wake(now):
        nonlocal batch, since
        if batch and now - since >= window:
            out[now] = batch
            sent.update({a[0]: now for a in batch})
            batch, since = [], now
        elif not batch:
            since = now

    for a in sorted(alerts, key=lambda a: (a[1], a[2], a[3])):
        since = a[1] if since is None else since
        while since + window <= a[1]:
            wake(since + window)
        if abs(a[6]) >= min_score and a[1] - sent.get(a[0], a[1] - cooldown) >= cooldown:
            batch.append(a)
        wake(a[1])
    if batch:
        out[since + window] = batch
    return out


def alerts(n, seed, rate=20):
    rng = random.Random(seed)
    t, rows = 0, []
    for k in range(n):
        t += rng.choice([0, rng.randrange(rate * NS), rng.randrange(rate * NS), rng.randrange(300 * NS)])
        rows.append((rng.choice("ABCDEFG"), t, k, rng.randrange(3), rng.choice(["cusum", "robust_z", "odd"]), 1234.5 + k, rng.choice([-1, 1]) * rng.choice([2.0, 6.0, 7.25, 5.99]), "{}"))
    return rows


@pytest.mark.parametrize("seed,piece_rows", [(1, None), (2, 300), (3, 150)])
def test_digests_equal_the_senders(spark, seed, piece_rows):
    rows = alerts(1500, seed)
    wanted = sender(rows, 60 * NS, 6.0, 900 * NS)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in mail.told(df, piece_rows=piece_rows).collect():
        got.setdefault(r.digest_ns, []).append((r.symbol, r.ts_ns, r.kind, r.price, r.score))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted((a[0], a[1], *a[4:7]) for a in v) for k, v in wanted.items()}
    assert len(wanted) > 60 and any(len({a[0] for a in v}) > 3 for v in wanted.values()) and any(len(v) > len({a[0] for a in v}) for v in wanted.values())


def test_texts(spark, monkeypatch):
    one = [("BTC/USD", 1_700_000_000 * NS + 5, 1, 0, "cusum", 41234.5, 6.25, '{"cusum_h": 5.0}')]
    m = mail.mails(spark.createDataFrame(one, SCHEMA), "csv").collect()
    assert [(r.digest_ns, r.part, r.n, r.n_symbols, r.subject) for r in m] == [(1_700_000_060 * NS + 5, 0, 1, 1, "[driftwatch] BTC/USD cusum (+6.2)")]
    lines = m[0].body.split("\n")
    assert lines[0] == "1 alert on the feed csv." and lines[2] == "2023-11-14 22:13:20 UTC  BTC/USD  cusum  score +6.25  [WARNING]  price 41,234.5000"
    assert lines[3] == "    WARNING: Cumulative drift +6.25 on BTC/USD (CUSUM threshold ±5.0)" and "a recording, not from a live feed" in m[0].body
    monkeypatch.setattr(mail, "LINES", 2)
    many = [(s, 10 * NS + k, k, 0, "robust_z", 1.0, -8.0, None) for k, s in enumerate("DBACD")]
    m = sorted(mail.mails(spark.createDataFrame(many, SCHEMA), "sip").collect(), key=lambda r: r.part)
    assert [r.part for r in m] == [0, 1, 2] and {r.subject for r in m} == {"[driftwatch] 5 alerts on A, B, C…"} and {r.n_symbols for r in m} == {4}
    assert [r.body.count(" UTC  ") for r in m] == [2, 2, 1] and "live feed" not in m[0].body
    assert mail.mails(spark.createDataFrame([], SCHEMA), "sip").count() == 0


def test_table_function_equals_detect(spark):
    events = stream(spark, 4000, seed=12)
    register_detectors(spark, P)
    events.createOrReplaceTempView("some_events")
    got = spark.sql("SELECT * FROM detect_alerts(TABLE(some_events) PARTITION BY symbol ORDER BY (ts_ns, seq))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.detect(events, P).collect())) and got.count() > 100
