"""Gates from returns: windows, copulas and tensor trains against plain loops."""

import itertools

import numpy as np
import pytest

from driftwatch.operators import gates as G
from driftwatch.operators import models as M
from driftwatch.operators.tensor_trains import BinnedCopula, TensorTrain, compressed

NAMES = ["a", "b", "c"]


def returns(spark, x):
    return spark.createDataFrame([(k + 1, *map(float, row)) for k, row in enumerate(x)], "t bigint, " + ", ".join(f"{n} double" for n in NAMES))


def test_trains_of_full_rank_are_the_table_and_truncation_keeps_its_bound():
    rng = np.random.default_rng(2)
    table = rng.random((3, 4, 2, 3)) ** 4
    cells = np.array(list(itertools.product(*map(range, table.shape))))
    whole, lost = compressed(table, 99)
    assert lost == 0 and whole.at(cells).reshape(table.shape) == pytest.approx(table, abs=1e-12) and whole.total() == pytest.approx(table.sum())
    assert whole.ranks == [3, 6, 3]
    errors = []
    for rank in (1, 2, 3, 4):
        train, lost = compressed(table, rank)
        distance = np.linalg.norm(train.at(cells).reshape(table.shape) - table)
        assert max(train.ranks) <= rank and distance <= lost + 1e-12
        assert train.total() == pytest.approx(train.at(cells).sum())
        errors.append(lost)
    assert errors == sorted(errors, reverse=True) and errors[0] > errors[-1]
    product = np.einsum("i,j,k->ijk", *(rng.random(4) for _ in range(3)))
    assert compressed(product, 1)[1] < 1e-12  # independent columns need no more


def test_binned_copula_of_full_rank_is_the_joint_histogram(spark):
    x = np.random.default_rng(5).normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    model = BinnedCopula(x, 99)
    pmf = {tuple(r[:3]): r.p for r in M.joint_pmf(returns(spark, x), NAMES, 4).collect()}
    for cell, p in zip(map(tuple, model.bins(x)), model.probability(x)):
        assert p == pytest.approx(pmf[cell], abs=1e-12)
    never = next(c for c in itertools.product(range(4), repeat=3) if c not in pmf) if len(pmf) < 64 else None
    assert never is None or model.train.at(np.array([never]))[0] == pytest.approx(0, abs=1e-12)
    assert model.log_likelihood(x + 100).min() >= np.log(1e-9)
    small = BinnedCopula(x, 1)
    assert small.train.ranks == [1, 1] and small.error > 0.01
    assert isinstance(small.train, TensorTrain)


def test_gaussian_copula_by_its_formula():
    x = np.random.default_rng(6).normal(size=(80, 2)) @ np.array([[1, 0.8], [0, 0.6]])
    model = M.TCopula(x, gaussian=True)
    rho, u = model.r[0, 1], model.uniform(x)
    from statistics import NormalDist

    z = np.vectorize(NormalDist().inv_cdf)(u)
    wanted = -0.5 * np.log(1 - rho**2) - (rho**2 * (z**2).sum(1) - 2 * rho * z[:, 0] * z[:, 1]) / (2 * (1 - rho**2))
    assert rho > 0.5 and model.log_likelihood(x) == pytest.approx(wanted, abs=1e-10)


def test_peaks_of_copulas_equal_a_loop(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(420, 3))
    x[300:306] *= 4
    onsets = [("early", "quiet", 20), ("crash", "crisis", 300), ("calm", "quiet", 250), ("last", "crisis", 415), ("short", "crisis", 95)]
    win = G.event_windows(returns(spark, x), spark.createDataFrame(onsets, "event string, type string, onset bigint"), ref=100, gap=10)
    got = {(r.event, r.method): (r.type, r.peak_z, r.peak_day) for r in G.peaks(G.copula_scores(win, NAMES, ("gaussian", "t", "mps_chi2"))).collect()}
    wanted = {}
    for event, kind, onset in onsets:
        end = max(0, onset - 1 - 10)
        start = max(0, end - 100)
        if end - start < 80:
            continue
        ref, own = x[start:end], x[onset - 1 : onset + 19]
        for name in ("gaussian", "t", "mps_chi2"):
            model = G.COPULAS[name](ref)
            roll = lambda y: np.convolve(model.log_likelihood(y), np.ones(5), "valid")  # noqa: B023, E731
            null = roll(ref)
            z = (roll(own) - null.mean()) / null.std(ddof=1)
            wanted[event, name] = (kind, z.min(), int(z.argmin()))
    assert got.keys() == wanted.keys() and len({e for e, _ in got}) == 4
    for k, (kind, z, day) in wanted.items():
        assert got[k] == (kind, pytest.approx(z, abs=1e-9), day)


def test_a_reference_without_spread_has_no_peak(spark):
    x = np.zeros((140, 3))
    win = G.event_windows(returns(spark, x), spark.createDataFrame([("e", "crisis", 120)], "event string, type string, onset bigint"), ref=100, gap=10)
    assert {(r.peak_z, r.peak_day) for r in G.peaks(G.marginal_scores(win, NAMES)).collect()} == {(0.0, 0)}
    assert G.event_windows(returns(spark, x), spark.createDataFrame([], "event string, type string, onset bigint")).count() == 0
