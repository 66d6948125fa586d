"""Whitening against numpy's dense eigenvectors."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from claimgrid.llm import feast_whitening as fw

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *(T.StructField(c, T.StringType()) for c in ("label", "x", "n", "k", "place", "component")),
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["1"] * 6) for i, v in rows], VECTORS).repartition(3)


def check(rows, got, most=32):
    fine = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(Counter(len(x) for _, x in fine).items(), key=lambda p: (p[1], p[0]))[0]
    fine = [(i, x) for i, x in fine if len(x) == d]
    n, sums = len(fine), [sum(col) for col in zip(*(x for _, x in fine))]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for _, x in fine])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-11 * np.abs(cov).sum(1).max()).sum()))
    assert len(got) == n * k
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
    assert Counter(i for i, _ in fine) == {i: len(rs) // k for i, rs in by_row.items()}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for (i, x), c in zip(fine, centred):
        for r in by_row[i]:
            assert r.deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums))
            assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
            want = c @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1])
            if abs(want) > 1e-6:
                sign = signs.setdefault(r.component, math.copysign(1, want * r.whitened))
                assert r.whitened * sign == pytest.approx(want, rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("d,n", [(40, 300), (5, 50), (64, 20)])
def test_random_vectors(spark, d, n):
    r = np.random.default_rng(d)
    data = r.standard_normal((n, d)) * np.linspace(0.05, 3, d)
    rows = [(i * 3, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, []), (905, [1.0])]
    rows.append(rows[0])
    check(rows, fw.whitened(frame(spark, rows)).collect())


def test_equal_eigenvalues(spark):
    """Two components with one value have no vectors of their own, but the whitened rows have one covariance."""
    rows = []
    for k in range(6):
        for s in (-1.0, 1.0):
            v = [0.0] * 6
            v[k] = s
            rows.append((len(rows), v))
    got = fw.whitened(frame(spark, rows)).collect()
    table = np.zeros((12, 6))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(1 / 6, rel=1e-9)
    assert np.abs(table.T @ table / 12 - np.eye(6)).max() < 1e-9 and got[0].identity_error < 1e-9


def test_no_variance(spark):
    assert fw.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert fw.whitened(frame(spark, [(1, None)])).count() == 0
    assert fw.whitened(frame(spark, [(1, [1.0])]).where("false")).count() == 0


def test_huge_deviations():
    x = np.array([[2**40, 0], [0, 2**33]], np.int64)
    assert fw.deviations(x, 2, [2**40, 2**33]) == [None, None]
    assert fw.deviations(np.array([[2**31, 0]], np.int64), 1, [0, 0]) == [2**62]


def test_inertia_and_intervals():
    r = np.random.default_rng(4)
    for values in (r.random(30), np.repeat([1.0, 2.0, 5.0], 10), np.r_[np.zeros(20), np.arange(10.0)], np.logspace(-9, 0, 30)):
        q = np.linalg.qr(r.standard_normal((30, 30)))[0]
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        for shift in (-0.5, 0.3333, 1.5, 4.2):
            assert fw.count_above(matrix, shift) == (values > shift).sum()
        found, vectors = fw.leading_components(matrix, 12)
        want = np.sort(values)[::-1][: len(found)]
        assert np.abs(found - want).max() < 1e-12 and np.abs(matrix @ vectors - vectors * found).max() < 1e-12
