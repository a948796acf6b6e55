import math
import random
from fractions import Fraction

import numpy as np
import pytest

from driftwatch.llm import whitening
from driftwatch.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, "clash") for i, v in rows], SCHEMA)


def brute(rows):
    """Exact sums in fractions, the covariance as a whole matrix."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in kept:
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), c @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))))
    return n, out, values[::-1] / values.sum()


def held(got, rows, k=16, tolerance=1e-9):
    n, wanted, explained = brute(rows)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes][:7] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    found = {}
    for r in got.collect():
        assert r.n == n and r.identity_error < 1e-9 and r.residual < 1e-12
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        found.setdefault(r.vec_id, {}).setdefault(r.component, []).append((r.deviation, r.whitened))
    assert found.keys() == wanted.keys()
    signs = {}
    for i, own in wanted.items():
        assert len(found[i]) == k and all(len(x) == len(own) for x in found[i].values())
        for c, values in found[i].items():
            expected = sorted((d, w[c - 1]) for d, w in own)
            assert sorted(d for d, _ in values) == [d for d, _ in expected]
            for (_, a), (_, b) in zip(sorted(values, key=lambda x: (x[0], abs(x[1]))), sorted(expected, key=lambda x: (x[0], abs(x[1])))):
                if abs(b) > 0.01:
                    assert signs.setdefault(c, np.sign(a * b)) == np.sign(a * b)
                assert abs(a) == pytest.approx(abs(b), rel=tolerance, abs=tolerance)


def test_against_the_whole_matrix(spark):
    df = table(spark, SF, "embeddings")
    held(whitening.whiten(df), [(r.vec_id, r.embedding) for r in df.collect()], tolerance=1e-8)


def test_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(2)
    vector = lambda: [rng.gauss(0, s) for s in (3, 2, 1.5, 1, 0.7)]
    rows = [(k, vector()) for k in range(80)]
    rows += [rows[3], rows[3], (500, rows[4][1]), (None, vector()), (600, None), (601, [1.0, None, 2.0, 0.0, 1.0]), (602, [1.0, math.nan, 2.0, 0.0, 1.0]), (603, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    rows += [(700 + k, rows[5][1]) for k in range(60)]  # one vector in a third of the rows
    held(whitening.whiten(frame(spark, rows)), rows, k=5)
    again = frame(spark, [*rows, (800, [1.0, 2.0]), (801, [])])  # other lengths take no part
    held(whitening.whiten(again), rows, k=5)


def test_nothing_varies(spark):
    same = [(k, [0.5, -0.5, 1.0]) for k in range(9)]
    for rows in ([], [(1, None)], same[:1], same):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]  # one direction alone
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-12


def test_deviations_are_exact_and_null_beyond_a_long():
    rng = random.Random(4)
    for n, top in ((5, 10**6), (10**6, 10**3), (3, 2**59)):
        x = np.array([[rng.randrange(-top, top) for _ in range(4)] for _ in range(30)])
        sums = [rng.randrange(-n * top, n * top) for _ in range(4)]
        exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert whitening.Centre(n, sums).deviations(x) == [e if e < 2**63 else None for e in exact]


def test_components_of_large_and_awkward_matrices():
    rng = np.random.default_rng(1)
    for d, values in ((400, 1 / np.arange(1, 401)), (400, np.linspace(1.1, 1, 400)), (90, np.repeat([3.0, 2, 1], 30)), (50, np.r_[np.ones(3), np.zeros(47)])):
        u = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = (u * values) @ u.T
        e, w, residual, passes = whitening.components(lambda q: v @ q, d, 16)
        assert residual < 1e-12 and passes < 120
        positive = np.sort(values)[::-1][:16]
        assert np.allclose(e, positive[positive > 0], rtol=1e-10) and np.allclose(w.T @ w, np.eye(len(e)), atol=1e-12)
