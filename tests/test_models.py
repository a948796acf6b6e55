"""Walk-forward scores against a plain loop, and the days that the queries over them score."""

import numpy as np
import pytest

import __spark_entry__
from driftwatch.operators import models as M
from driftwatch.plans import queries as plans
from driftwatch.sources import views as V


def by_loop(x, ref, roll, every):
    out = {}
    for start in range(ref + roll, len(x), every):  # the first day of a block, counted from 0
        reference = x[start - roll - ref : start - roll]
        model = M.TCopula(reference)
        null = np.convolve(model.log_likelihood(reference), np.ones(roll), "valid")
        for day in range(start, min(start + every, len(x))):
            own = model.log_likelihood(x[day - roll + 1 : day + 1]).sum()
            out[day + 1] = (own - null.mean()) / null.std(ddof=1)
    return out


def test_walk_forward_equals_a_loop(spark):
    x = np.random.default_rng(3).normal(size=(131, 2))
    df = spark.createDataFrame([(k + 1, *map(float, row)) for k, row in enumerate(x)], "t bigint, a double, b double")
    got = {r.t: r.z for r in M.walk_forward(df, ["a", "b"], ref=60).collect()}
    wanted = by_loop(x, 60, 5, 20)
    assert got.keys() == wanted.keys() == set(range(66, 132))
    assert all(got[t] == pytest.approx(wanted[t]) for t in wanted)


def test_queries_score_all_days(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(640, 8))
    returns = spark.createDataFrame([(k + 1, *map(float, row)) for k, row in enumerate(x)], "t bigint, " + ", ".join(f"{r} double" for r in plans.RETURNS))
    monkeypatch.setattr(V, "returns", lambda spark, d: returns)
    z = {r.t: r.z for r in __spark_entry__.queries()["t_copula_score"](spark, "").collect()}
    assert z.keys() == set(range(258, 641))
    alerts = {r.t: r.score for r in __spark_entry__.queries()["walk_forward"](spark, "").collect()}
    assert alerts == {t: v for t, v in z.items() if abs(v) >= 3}
    wanted = by_loop(x, 252, 5, 20)
    assert all(z[t] == pytest.approx(wanted[t], abs=1e-5) for t in wanted)
