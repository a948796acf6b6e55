import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import nearest
from driftwatch.llm.common import table

SCHEMA = "vec_id bigint, embedding array<double>, rank string, score int, query_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, asks, k=10):
    """All distances, in doubles; an id once, with its nearest vector."""
    fine = lambda v: v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and fine(v)]
    out = {}
    for q, v in rows:
        if asks(q):
            far = out.setdefault(q, {})
            for i, w in rows:
                if i != q:
                    d = float(np.sqrt(((v - w) ** 2).sum()))
                    far[i] = min(d, far.get(i, math.inf))
    return {q: sorted((d, i) for i, d in far.items())[:k] for q, far in out.items()}


def answers(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "double"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_exact_scores(spark, sf):
    df = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, wanted = answers(nearest.nearest(df, F.col("vec_id") % 100 == 0)), brute(rows, lambda q: q % 100 == 0)
    assert got.keys() == wanted.keys() and all(len(got[q]) == 10 for q in got)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in got)
    assert hits / sum(map(len, wanted.values())) >= 0.93
    of = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert found == sorted(found)
        for d, i in found:
            assert d == pytest.approx(float(np.linalg.norm(of[q] - of[i])), rel=1e-14)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    """Small enough that every list is probed: equal to brute force."""
    rng = random.Random(9)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(6)]) for k in range(150)]  # many ties
    rows += [rows[100], rows[100], rows[7], (7, [1.0, 1.0, 1.0, 1.0, 1.0, 1.5]), (100, [0.5] * 6)]
    rows += [(None, [1.0] * 6), (200, None), (300, [0.0] * 6), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [math.nan] + [1.0] * 5), (600, [math.inf] + [1.0] * 5)]
    asks = lambda q: q % 50 == 0
    wanted = brute(rows, asks)
    assert answers(nearest.nearest(frame(spark, [*rows, (700, [1.0]), (800, [])]), F.col("vec_id") % 50 == 0)) == wanted


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [4.0, 6.0])]
    for some in ([], rows[:1], rows[2:], [(0, None)]):
        assert nearest.nearest(frame(spark, some), F.col("vec_id") % 100 == 0).count() == 0
    assert answers(nearest.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0)) == {0: [(0.0, 100), (5.0, 3)], 100: [(0.0, 0), (5.0, 3)]}


def test_one_group_in_a_third_of_the_rows(spark, monkeypatch):
    """Lists longer than a cell; near copies beside a spread of others."""
    monkeypatch.setattr(nearest, "CELL_ROWS", (32, 64))
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(24)
    rows = [(k, (hot + 1e-4 * rng.standard_normal(24) if k % 3 == 0 else rng.standard_normal(24)).tolist()) for k in range(1500)]
    wanted, got = brute(rows, lambda q: q % 100 == 0), answers(nearest.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in wanted) / 150 >= 0.93


def test_cells_find_all_within_the_bound_and_abandon_most():
    rng = np.random.default_rng(8)
    base, asked = rng.standard_normal((3000, 128)), rng.standard_normal((40, 128))
    coarse = nearest.Coarse(base[:1], np.linalg.qr(rng.standard_normal((128, 128)))[0], list(range(0, 129, 16)), 1)
    far = np.sqrt(((asked[:, None] - base[None]) ** 2).sum(2))
    near = np.argsort(far, axis=1)[:, :10]
    bounds = np.take_along_axis(far, near, 1)[:, -1]
    cell = nearest.Cell(np.arange(3000), base, coarse.blocks(base), 10)
    for bound in (bounds, np.full(40, np.inf)):
        q, c, d = cell.best(np.arange(-40, 0), asked, coarse.blocks(asked), bound)
        found = [set(c[q == k]) & set(near[k]) for k in range(40)]
        assert sum(map(len, found)) >= 390 and np.allclose(d, far[q, c], rtol=1e-15)
    assert sum(map(len, found)) == 400  # nothing to beat, nothing abandoned
