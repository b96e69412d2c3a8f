"""Factors of tall matrices keep what a matrix of products loses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.stats import moments, triangle
from quillon.operators.decomposition import PCA
from quillon.operators.linear import LinearRegression


def frame(spark, x, y=None, parts=7):
    rows = [(a.tolist(), float(b)) for a, b in zip(x, np.zeros(len(x)) if y is None else y, strict=True)]
    return spark.createDataFrame(rows, "features array<double>, y double").repartition(parts)


def ill(seed, n=900, d=5):
    r = np.random.default_rng(seed)
    u = np.linalg.qr(np.column_stack([np.ones(n), r.normal(size=(n, d))]))[0][:, 1:]  # centred columns
    v = np.linalg.qr(r.normal(size=(d, d)))[0]
    s = np.logspace(0, -10, d) * 100
    return u * s @ v.T, s, v


def test_small_singular_values_survive(spark):
    x, s, v = ill(1)
    m = PCA().fit(frame(spark, x))
    assert np.allclose(m.singular_values_, s, rtol=1e-6)
    assert np.allclose(np.abs(m.components_ @ v), np.eye(5), atol=1e-5)
    lost = np.sqrt(np.maximum(np.linalg.eigvalsh(moments(frame(spark, x)).scatter)[::-1], 0))
    assert not np.allclose(lost, s, rtol=1e-2)


def test_least_squares_of_an_ill_conditioned_matrix(spark):
    x, _, _ = ill(2)
    w = np.arange(1.0, 6)
    m = LinearRegression().fit(frame(spark, x, x @ w + 3))
    assert np.allclose(m.predict(frame(spark, x)).select("prediction").toPandas()["prediction"].sort_values(), np.sort(x @ w + 3), atol=1e-9)
    assert abs(m.intercept_ - 3) < 1e-9


@pytest.mark.parametrize("ones", [True, False])
def test_the_factor(spark, ones):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(57, 3)) + 5, r.normal(size=57)
    whole = np.column_stack([*([np.ones(57)] if ones else []), x, y])
    for parts in (1, 40):
        got = triangle(frame(spark, x, y, parts), "features", "y", ones)
        assert np.allclose(got.T @ got, whole.T @ whole) and np.allclose(got, np.triu(got))
    if ones:
        assert np.isclose(got[0, 0] ** 2, 57) and np.allclose(got[0, 1:-1] / got[0, 0], x.mean(0))
    few = triangle(frame(spark, x[:2]), ones=False)
    assert few.shape == (3, 3) and np.allclose(few.T @ few, x[:2].T @ x[:2])


def test_equal_columns_share_their_weight(spark):
    x = np.column_stack([np.arange(30.0), np.arange(30.0)])
    m = LinearRegression().fit(frame(spark, x, 4 * x[:, 0]))
    assert np.allclose(m.coef_, [2, 2]) and abs(m.intercept_) < 1e-9
    assert frame(spark, x).where(F.size("features") != 2).count() == 0
