"""Trees, forests and boosting are the same at every size, and equal to a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators.ensemble import POISSON, AdaBoostClassifier, GradientBoostingClassifier, RandomForestClassifier, bag_counts
from quillon.operators.tree import DecisionTreeClassifier, DecisionTreeRegressor, Rules, grow_all, grow_local, prefix_scan


def shape(tree, k=0):
    """A tree without its nodes' numbers."""
    if tree.feature[k] < 0:
        return (tree.rows[k], np.round(tree.value[k], 9).tolist())
    return (tree.feature[k], round(tree.threshold[k], 9), shape(tree, tree.left[k]), shape(tree, tree.right[k]))


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(400, 6)), 1)
    y = ((x[:, 0] + x[:, 3] > 0.3).astype(int) + (x[:, 1] > 1)).clip(0, 2)
    flip = r.random(400) < 0.15
    y[flip] = r.integers(3, size=flip.sum())
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, y long").repartition(5)
    return x, y, df.persist()


@pytest.mark.parametrize("cells", [0, 600, 10**9])
def test_a_forest_is_the_same_at_every_size(spark, rows, cells):
    x, y, df = rows
    m = RandomForestClassifier(3, max_depth=4, max_features=2, min_samples_leaf=2, random_state=7).fit(df, local_cells=cells)
    names = spark.createDataFrame([(str(i),) for i in range(400)], "name string")
    bags = {r["name"]: r["w"] for r in names.select("name", bag_counts(F.col("name"), m.seed_, 3).alias("w")).collect()}
    w = np.array([bags[str(i)] for i in range(400)])
    for t, tree in enumerate(m.trees_):
        own = w[:, t] > 0
        plain = grow_local(x[own], np.eye(3)[y[own]] * w[own, t, None], Rules("gini", 4, min_samples_leaf=2, max_features=2), f"{m.seed_}:{t}", times=w[own, t])
        assert shape(tree) == shape(plain)
    assert tree.rows[0] == w[:, 2].sum()


def test_bags_are_poisson_numbers(spark):
    w = np.array([r["w"] for r in spark.range(4000).select(bag_counts(F.col("id").cast("string"), 1, 2).alias("w")).collect()])
    for k in range(4):
        expected = POISSON[0] if k == 0 else POISSON[k] - POISSON[k - 1]
        assert abs((w == k).mean() - expected) < 0.02
    assert abs(np.corrcoef(w.T)[0, 1]) < 0.05


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_classification_levels(rows, criterion):
    x, y, df = rows
    whole = DecisionTreeClassifier(criterion, max_depth=5, min_samples_leaf=3).fit(df, local_cells=10**9)
    for cells in (0, 700):
        assert shape(DecisionTreeClassifier(criterion, max_depth=5, min_samples_leaf=3).fit(df, local_cells=cells).tree_) == shape(whole.tree_)
    assert np.isclose(whole.feature_importances_.sum(), 1)


def test_regression_levels_and_weights(spark, rows):
    x, _, _ = rows
    z, w = np.sin(2 * x[:, 0]) + x[:, 1], np.arange(400) % 4
    df = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, z, w, strict=True)], "features array<double>, y double, w double")
    own = w > 0
    plain = [DecisionTreeRegressor(max_depth=4, max_features=0.5, random_state=3).fit(df, weight="w", local_cells=c) for c in (0, 500, 10**9)]
    assert shape(plain[0].tree_) == shape(plain[1].tree_) == shape(plain[2].tree_)
    assert plain[0].tree_.rows[0] == own.sum()


def test_boosting_is_the_same_at_every_size(rows):
    _, _, df = rows
    a, b = (AdaBoostClassifier(4, max_depth=2).fit(df, local_cells=c) for c in (0, 10**9))
    assert np.allclose(a.estimator_errors_, b.estimator_errors_) and [shape(t) for t in a.trees_] == [shape(t) for t in b.trees_]
    a, b = (GradientBoostingClassifier(n_estimators=2, max_depth=2, subsample=0.7, random_state=1).fit(df, local_cells=c) for c in (0, 10**9))
    assert np.allclose(a.train_score_, b.train_score_) and len(a.trees_[0]) == 3


def test_adaboost_weights_follow_the_rule(rows):
    x, y, df = rows
    m = AdaBoostClassifier(3).fit(df)
    w = np.ones(400)
    for tree, err, alpha in zip(m.trees_, m.estimator_errors_, m.estimator_weights_, strict=True):
        miss = tree.value[tree.leaves(x)].argmax(1) != y
        assert np.isclose(err, w[miss].sum() / w.sum()) and np.isclose(alpha, np.log((1 - err) / err) + np.log(2))
        w = w * np.exp(alpha * miss)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_prefix_scan(spark, parts):
    r = np.random.default_rng(parts)
    values = sorted({(int(a), int(b), float(c)) for a, b, c in zip(r.integers(3, size=500), r.integers(2, size=500), np.round(r.normal(size=500), 2), strict=True)})
    df = spark.createDataFrame([(*v, float(k)) for k, v in enumerate(values)], "node int, f int, v double, n double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_scan(df.repartition(3), ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({x["range"] for x in got}) > parts / 2
    ends = {(x["range"], x["node"], x["f"]): (x["last"], x["before"][0]) for x in got if x["ending"]}
    for (node, f), own in {(v[0], v[1]): [(w[2], float(k)) for k, w in enumerate(values) if w[:2] == v[:2]] for v in values}.items():
        total, last = 0.0, None
        for v, n in own:
            x = next(x for x in got if not x["ending"] and (x["node"], x["f"], x["v"]) == (node, f, v))
            earlier = sorted(k[0] for k in ends if k[1:] == (node, f) and k[0] < x["range"])
            assert x["before"][0] + sum(ends[k, node, f][1] for k in earlier) == total
            assert (x["last"] if x["last"] is not None else ends[earlier[-1], node, f][0] if earlier else None) == last
            total, last = total + n, v


def test_a_wider_row_is_refused(spark, rows):
    _, _, df = rows
    wide = df.withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    models = [DecisionTreeClassifier(max_depth=1).fit(df), DecisionTreeRegressor(max_depth=1).fit(df), RandomForestClassifier(1, max_depth=1).fit(df), AdaBoostClassifier(1).fit(df), GradientBoostingClassifier(n_estimators=1, max_depth=1).fit(df)]
    for m in models:
        with pytest.raises(Exception, match="expected 6 features"):
            m.predict(wide).collect()


def test_trees_without_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 2.0], 1)], "row_id long, features array<double>, y long")
    m = RandomForestClassifier(12, random_state=0).fit(df)
    assert all(np.isfinite(t.value).all() for t in m.trees_) and m.predict(df).count() == 2
    trees = grow_all(df.select(F.col("features").alias("x"), F.array(F.lit(1.0), F.lit(0.0)).alias("s"), F.array(F.lit(0.0), F.lit(1.0)).alias("w")), 2, 2, Rules("gini"), ["a", "b"])
    assert [t.rows[0] for t in trees] == [0, 2]


def test_a_task_sends_one_row_for_each_value():
    from quillon.operators.tree import _added_up

    rng = np.random.default_rng(5)
    slot, x, s, n = rng.integers(0, 2, 1000), rng.integers(-2, 3, (1000, 2)) * 0.5, rng.integers(0, 9, (1000, 3)).astype(float), np.ones(1000)
    tried = np.array([[True, True], [True, False]])
    got = {(int(k), int(f), float(v)): list(map(float, z)) for columns in _added_up(slot, x, s, n, tried) for k, f, v, *z in zip(*columns)}
    want = {(k, f, v): [float(own.sum()), *s[own].sum(0)] for k in (0, 1) for f in (0, 1) if tried[k, f] for v in (-1.0, -0.5, 0.0, 0.5, 1.0) for own in [(slot == k) & (x[:, f] == v)]}
    assert got == want and sum(len(c[0]) for c in _added_up(slot, x, s, n, tried)) == 15


@pytest.mark.parametrize("k", [2, 3])
def test_all_rounds_of_boosting_in_one_pass(spark, k):
    df = spark.range(60).selectExpr("id AS row_id", "array(double(id % 7), double(id % 11)) AS features", f"(id * 5 + id div 4) % {k} AS y")
    m = GradientBoostingClassifier(0.3, n_estimators=3, max_depth=2, subsample=0.8, random_state=1).fit(df, local_cells=0)
    whole = {r["row_id"]: np.reshape(r["stages"], (3, -1)) for r in m.staged(df).collect()}
    for j, one in enumerate(m.staged_decision_function(df)):
        assert all(np.allclose(np.ravel(r["decision"]), whole[r["row_id"]][j], atol=1e-12) for r in one.collect())
