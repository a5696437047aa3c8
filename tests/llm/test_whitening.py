"""Operator 12."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import common, whitening
from rankloom.llm.queries import op12_whitening

SF = "/root/testdata/sf0.001"


def plain(x):
    """(n, sums, eigenvalues falling, eigenvectors) of distinct integer rows by numpy's symmetric solver."""
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return len(fit), fit.sum(0), values[::-1], vectors[:, ::-1]


def test_query_against_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(int)
    n, sums, values, vectors = plain(x)
    df = op12_whitening(spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    by = defaultdict(dict)
    for r in df.collect():
        by[r.component][r.vec_id] = r
    assert sorted(by) == [1, 2, 3, 4]
    for k, own in by.items():
        want = (x - sums / n) @ vectors[:, k - 1] / math.sqrt(values[k - 1])
        have = np.array([own[r.vec_id].whitened for r in rows])
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-9)
        for r, v in zip(rows, x, strict=True):
            assert own[r.vec_id].n == n and own[r.vec_id].deviation == int(((n * v - sums) ** 2).sum())
            assert own[r.vec_id].explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-10)
            assert own[r.vec_id].identity_error < 1e-10


@pytest.mark.parametrize("d", [1, 2, 5, 8])
def test_jacobi(d):
    r = np.random.default_rng(d).normal(size=(d, d)) * 10.0 ** -np.arange(0, 2 * d, 2)
    v, norms = whitening.jacobi(r)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.all(np.diff(norms) <= 0)
    left = r @ v / norms
    assert np.allclose(left.T @ left, np.eye(d), atol=1e-12)
    assert np.allclose(norms, np.linalg.svd(r, compute_uv=False), rtol=1e-10)  # small ones to relative accuracy
    met = [(p, q) for a, b in whitening.rounds(d) for p, q in zip(a, b, strict=True)]
    assert sorted(met) == [(p, q) for p in range(d) for q in range(p + 1, d)]


def test_small_deviations_are_accurate(spark):
    """A covariance matrix would lose the third direction in rounding: 1 beside 2 ** 30."""
    g = np.random.default_rng(1)
    x = np.stack([g.integers(-(2**30), 2**30, 400), g.integers(-1000, 1000, 400), g.integers(-1, 2, 400)], 1)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(7)
    model = whitening.fit(df, "x")
    exact = np.linalg.svd((x - x.mean(0)) / 20.0, compute_uv=False)  # of 400 rows
    assert np.allclose(model.deviations, exact, rtol=1e-9) and model.error < 1e-9


def test_tree_of_triangles(spark):
    g = np.random.default_rng(2)
    x = g.integers(-50, 50, (600, 6))
    df = common.stage(spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(40), "many")
    r = whitening.triangle(df, "x", 600, x.sum(0).tolist())
    c = x - x.mean(0)
    assert np.allclose(r.T @ r, c.T @ c)


ODD = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0]), (8, [0.5, -0.001]), (9, [-1.0, 1.0]), (9, [-1.0, 1.0]), (None, [0.0, 0.25]), (11, [-0.0, 3.0])]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, v, "w", "n") for i, v in ODD], "vec_id long, embedding array<float>, white string, deviation string")
    left = whitening.usable(df.withColumn("x", whitening.quantised(F.col("embedding"))), "x")
    assert sorted(map(str, [r.vec_id for r in left.collect()])) == sorted(map(str, [8, 9, 9, None, 11]))
    x = np.array([[128, -1], [-256, 256], [0, 64], [0, 768]])
    n, sums, values, _ = plain(x)
    model = whitening.fit(left, "x")
    assert (model.n, list(model.sums)) == (4, sums.tolist()) and np.allclose(model.deviations**2, values)
    white, apart = common.fresh(left, "white"), common.fresh(left, "deviation")
    rows = whitening.transform(left, "x", model, white, apart).collect()
    assert len(rows) == 5 and all(r.white == "w" and r.deviation == "n" for r in rows)
    for r in rows:
        assert int(r[apart]) == sum((n * a - s) ** 2 for a, s in zip(r.x, sums.tolist(), strict=True))
        assert sum(w * w for w in r[white]) == pytest.approx((np.array(r.x) - sums / n) @ np.linalg.inv(np.cov(x.T, bias=True)) @ (np.array(r.x) - sums / n))


def test_without_variance_or_rows(spark):
    same = spark.createDataFrame([([5, 6],)] * 4, "x array<long>")
    model = whitening.fit(same, "x")
    assert model.n == 1 and len(model.deviations) == 0 and model.error == 0
    assert [r.white for r in whitening.transform(same, "x", model).collect()] == [[]] * 4
    assert whitening.fit(same.limit(0), "x") is None and whitening.usable(same.limit(0), "x").count() == 0
    line = whitening.fit(spark.createDataFrame([([k, 2 * k, 7],) for k in range(9)], "x array<long>"), "x")
    assert len(line.deviations) == 1 and line.components[:, 0] == pytest.approx([1 / 5**0.5, 2 / 5**0.5, 0])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op12_whitening(spark, str(tmp_path)).collect() == []


def test_exact_deviations_beyond_64_bits(spark):
    rows = [([2**30 if k < 3 else 2**40, k],) for k in range(4)]
    df = spark.createDataFrame(rows, "x array<long>")
    model = whitening.Whitening(10**9, (5, 7), np.eye(2), np.ones(2), 1.0)
    assert [r.deviation for r in whitening.transform(df, "x", model).collect()] == [(10**9 * 2**30 - 5) ** 2 + (10**9 * k - 7) ** 2 for k in range(3)] + [None]
