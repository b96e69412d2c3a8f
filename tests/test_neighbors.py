"""The pivot index gives the rows of a full comparison, with fewer distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators.neighbors import KNeighborsClassifier, distances


def tables(spark, x, y, q):
    train = spark.createDataFrame([(3 * i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, y long").repartition(4)
    return train, spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(q)], "row_id long, features array<double>").repartition(3)


def plain(x, q, k, metric):
    out = set()
    for i, row in enumerate(distances(q, x, metric)):
        for rank, j in enumerate(sorted(range(len(x)), key=lambda j: (row[j], j))[:k], 1):
            out.add((i, 3 * j, rank, round(row[j], 9)))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_equals_a_full_comparison(spark, metric):
    r = np.random.default_rng(2)
    centres = r.normal(scale=20, size=(12, 4))
    x = np.round(centres[r.integers(12, size=3000)] + r.normal(size=(3000, 4)), 2)
    x[:900] = x[0]  # copies
    x[900:950] = np.round(x[900:950])  # ties
    q = np.vstack([np.round(centres[r.integers(12, size=150)] + r.normal(size=(150, 4)), 2), x[:3], x[900:930], r.normal(scale=200, size=(5, 4))])
    train, queries = tables(spark, x, r.integers(3, size=3000), q)
    m = KNeighborsClassifier(7, metric=metric).fit(train)
    got = {(r["row_id"], r["train_id"], r["rank"], round(r["distance"], 9)) for r in m.kneighbors(queries).collect()}
    assert got == plain(x, q, 7, metric)
    assert m.compared_.value < len(x) * len(q) / 2
    m.close()


@pytest.mark.parametrize("n,k,pivots", [(1, 1, 5), (9, 9, 1), (60, 25, 60)])
def test_small_tables(spark, n, k, pivots):
    r = np.random.default_rng(n)
    x, q = np.round(r.normal(size=(n, 2)), 1), np.round(r.normal(size=(20, 2)), 1)
    train, queries = tables(spark, x, r.integers(2, size=n), q)
    m = KNeighborsClassifier(k, max_pivots=pivots).fit(train)
    got = {(r["row_id"], r["train_id"], r["rank"], round(r["distance"], 9)) for r in m.kneighbors(queries).collect()}
    assert got == plain(x, q, k, "euclidean")


def test_the_plan_has_no_cross_join(spark):
    r = np.random.default_rng(0)
    train, queries = tables(spark, r.normal(size=(50, 2)), r.integers(2, size=50), r.normal(size=(5, 2)))
    plan = KNeighborsClassifier(3).fit(train).kneighbors(queries)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_votes_and_width(spark):
    r = np.random.default_rng(1)
    x, y, q = np.round(r.normal(size=(200, 2)), 1), r.integers(3, size=200), np.round(r.normal(size=(30, 2)), 1)
    train, queries = tables(spark, x, y, q)
    for weights in ("uniform", "distance"):
        m = KNeighborsClassifier(6, weights=weights).fit(train)
        said = {r["row_id"]: (r["prediction"], r["proba"]) for r in m.predict_both(queries).collect()}
        for i, row in enumerate(distances(q, x, "euclidean")):
            near = sorted(range(200), key=lambda j: (row[j], j))[:6]
            zero = row[near].min() == 0
            w = np.array([1.0 if weights == "uniform" else float(row[j] == 0) if zero else 1 / row[j] for j in near])
            votes = np.array([w[y[near] == c].sum() for c in range(3)])
            assert said[i][0] == votes.argmax() and np.allclose(said[i][1], votes / votes.sum())
    with pytest.raises(Exception, match="expected 2 features"):
        m.predict(queries.withColumn("features", F.concat("features", "features"))).collect()
