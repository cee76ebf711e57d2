"""Whitening against whole-number covariances."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokewise.llm import queries
from spokewise.llm import whitening as W

ROW = "vec_id long, embedding array<float>, n int, x string"


def clean(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, most=16):
    """Exact covariance in whole numbers: fitted count, deviation of each row, eigenvalue shares."""
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if clean(v)]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    centred = [[n * c - t for c, t in zip(x, s)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(most, int((e > 1e-13 * e[0]).sum()))
    out = {}
    for i, x in xs:
        y = np.array([n * c - t for c, t in zip(x, s)], dtype=float) / n @ vectors[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((sum((n * c - t) ** 2 for c, t in zip(x, s)), y))
    return n, out, e[:k] / np.trace(v)


def check(spark, rows, **more):
    got = W.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROW).repartition(3), **more).collect()
    n, want, share = brute(rows, **more)
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(want) and all(r.n == n for r in got)
    sign = {}
    for i, all_of in by.items():
        assert len(all_of) == len(want[i]) * len(share)
        assert {r.component for r in all_of} == set(range(1, len(share) + 1))
        for r in all_of:
            deviation, y = want[i][0]
            assert int(r.deviation) == deviation
            assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
            w = y[r.component - 1]
            if abs(w) > 1e-6:
                assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
                assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-6, abs=1e-9)
            assert r.identity_error < 1e-9
    return got


def vectors(n, d, seed=1, scale=1.0):
    r = random.Random(seed)
    mixed = [[r.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    return [(i, [scale * sum(a * b for a, b in zip(m, z)) for m in mixed]) for i in range(n) for z in [[r.gauss(0, 1) for _ in range(d)]]]


def test_exact(spark):
    rows = vectors(400, 20)
    rows += [(900, None), (901, [None] * 20), (902, [math.nan] * 20), (903, [math.inf] + [0.0] * 19), (904, []), rows[3], (905, rows[4][1]), (None, rows[5][1])]
    check(spark, rows)


def test_few_dimensions_and_rows(spark):
    check(spark, vectors(50, 3), most=2)
    check(spark, vectors(5, 12))  # four components span what five vectors do
    line = [(i, [float(i), 2.0 * i]) for i in range(9)]
    assert {r.component for r in check(spark, line)} == {1}


def test_very_unequal_spreads(spark):
    r = random.Random(5)
    check(spark, [(i, [r.gauss(0, 3e4), r.gauss(0, 1), r.gauss(0, 0.2)]) for i in range(300)])


def test_nothing_to_whiten(spark):
    of = lambda rows: W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert of([]) == [] and of([(1, None), (2, [])]) == [] and of([(1, [1.0, 2.0])]) == [] and of([(i, [1.0, 2.0]) for i in range(5)]) == []
    assert of([(1, [1e300, 1.0])]) == []


def test_other_lengths_give_no_rows(spark):
    rows = [(i, v) for i, v in vectors(30, 4)] + [(99, [1.0, 2.0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == set(range(30)) and {r.n for r in got} == {30}


def test_large_numbers_stay_exact():
    m = W.Mean.of(3, [10**18 + 1, 5, -7])
    x = np.array([[3 * 10**17, 2, -3], [10**17, 1, 1]])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, (10**18 + 1, 5, -7))) for row in x.tolist()]
    assert m.deviations(x) == want
    high, low = W.Mean.of(7, [7_000_003]).centred(np.array([[1_000_001]]))
    assert abs(Fraction(float(high[0, 0])) + Fraction(float(low[0, 0])) - Fraction(4, 7)) < Fraction(1, 10**30)


def test_sums_of_pairs_keep_what_doubles_lose():
    r = np.random.default_rng(2)
    c = r.standard_normal((1000, 3)) * [1e8, 1.0, 1e-8]
    high, low = W.outer_sum((c, np.zeros_like(c)))
    at = 0
    for i in range(3):
        for j in range(i, 3):
            exact = sum(Fraction(a) * Fraction(b) for a, b in zip(c[:, i].tolist(), c[:, j].tolist()))
            size = sum(abs(Fraction(a) * Fraction(b)) for a, b in zip(c[:, i].tolist(), c[:, j].tolist()))
            assert abs(Fraction(float(high[at])) + Fraction(float(low[at])) - exact) < size / 10**28
            at += 1


def test_equal_eigenvalues():
    e, x = W.components(np.diag([2.0, 5.0, 2.0, 2.0]), np.zeros((4, 4)), 16)
    assert np.allclose(e, [5, 2, 2, 2]) and np.allclose(x.T @ x, np.eye(4), atol=1e-15)


def test_query(spark, sf):
    got = queries.op12_whitening(spark, sf).collect()
    rows = queries.table(spark, sf, "embeddings").select("vec_id", F.col("embedding")).collect()
    n, want, share = brute([(r.vec_id, r.embedding) for r in rows])
    assert len(got) == sum(map(len, want.values())) * len(share)
    for r in got:
        assert r.n == n and r.deviation == want[r.vec_id][0][0] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(want[r.vec_id][0][1][r.component - 1]), rel=1e-6, abs=1e-9)
