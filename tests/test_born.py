"""The Born machine by brute force over all cells of three columns."""

import itertools
import math

import numpy as np
import pytest

from driftwatch.operators.born import BornMachine, stability


def correlated(n, seed, rho=0.8):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal(n)
    b = rho * a + math.sqrt(1 - rho * rho) * rng.standard_normal(n)
    return np.column_stack([a, b, rng.standard_normal(n)])


@pytest.fixture(scope="module")
def machine():
    return BornMachine(correlated(1500, 1), bins=4)


CELLS = np.array(list(itertools.product(range(4), repeat=3)))


def test_probabilities_sum_to_one_and_follow_the_data(machine):
    p = np.exp(machine.log_cells(CELLS))
    assert p.sum() == pytest.approx(1, abs=1e-9) and [c.shape for c in machine.cores] == [(1, 4, 4), (4, 4, 4), (4, 4, 1)]
    x = correlated(1500, 1)
    counts = np.zeros((4, 4, 4))
    np.add.at(counts, tuple(machine.bins(x).T), 1 / len(x))
    assert 0.5 * np.abs(p.reshape(4, 4, 4) - counts).sum() < 0.12  # total variation
    fresh = correlated(4000, 2)
    assert machine.log_likelihood(fresh).mean() > math.log(1 / 64) + 0.3  # independent columns give each cell 1 in 64


def test_samples_have_the_probabilities(machine):
    p, drawn = np.exp(machine.log_cells(CELLS)), machine.sample(200_000)
    share = np.bincount(drawn @ [16, 4, 1], minlength=64) / len(drawn)
    assert np.abs(share - p).max() < 0.004 and np.abs(share - p).sum() < 0.03
    assert (machine.sample(50) == machine.sample(50)).all()


def test_divergence_against_all_cells(machine):
    other = BornMachine(correlated(1500, 5, rho=-0.8), bins=4)
    other.edges, other.middles = machine.edges, machine.middles  # one grid, so that the sum over cells is exact
    p, q = machine.log_cells(CELLS), other.log_cells(CELLS)
    exact = float((np.exp(p) * (p - q)).sum())
    assert exact > 0.5 and machine.divergence(other, 100_000) == pytest.approx(exact, rel=0.05)
    assert abs(machine.divergence(machine)) < 1e-9


def test_stability_of_pairs_of_windows(spark):
    x = np.vstack([correlated(300, 3), correlated(300, 4, rho=-0.9)])
    df = spark.createDataFrame([(k + 1, *map(float, row)) for k, row in enumerate(x)], "t bigint, a double, b double, c double")
    got = {r.start: r for r in stability(df, ["a", "b", "c"], ref=120, apart=20, every=100).collect()}
    assert got.keys() == {1, 101, 201, 301}
    assert all(math.isfinite(r.divergence) and r.c5 and r.c4 == (abs(r.divergence) <= 0.5) for r in got.values())
    assert got[201].divergence > got[1].divergence  # before and after the change
    assert stability(df.where("t < 200"), ["a", "b", "c"], ref=120, apart=20).count() == 0
