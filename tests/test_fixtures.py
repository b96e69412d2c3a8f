"""Hand-computed fixtures, and comparisons with small NumPy twins."""

import gzip
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.base import ConvergenceWarning, NotFittedError
from quillon.operators import layers as N
from quillon.operators import metrics as M
from quillon.operators import optimizers as O
from quillon.operators.bayes import GaussianNB
from quillon.operators.cluster import DBSCAN, GaussianMixture, KMeans
from quillon.operators.decomposition import PCA, power_iteration
from quillon.operators.ensemble import AdaBoostClassifier, GradientBoostingClassifier, RandomForestClassifier
from quillon.operators.linear import Lasso, LinearRegression, LinearSVM, LogisticRegression, Ridge
from quillon.operators.neighbors import KNeighborsClassifier
from quillon.operators.preprocessing import MinMaxScaler, OneHotEncoder, StandardScaler
from quillon.operators.tokenizers import BPETokenizer, CharTokenizer, merge_once, replace_pair
from quillon.operators.tree import DecisionTreeClassifier, DecisionTreeRegressor, Rules, grow, grow_local, resolve_max_features
from quillon.sources import files, generators
from quillon.streaming.online import RunningMoments


def frame(spark, x, y=None):
    x = np.asarray(x, float).reshape(len(x), -1)
    rows = [(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y if y is not None else np.zeros(len(x))))]
    return spark.createDataFrame(rows, "row_id long, features array<double>, y double")


def column(df, name):
    return [r[name] for r in df.orderBy("row_id").collect()]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (0, 0)], "y int, prediction int")
    assert M.accuracy_score(df) == 0.75
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, prediction int")
    assert sorted(map(tuple, M.confusion_matrix(df).collect())) == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "y int, prediction int")
    assert all(abs(f(df) - 2 / 3) < 1e-12 for f in (M.precision_score, M.recall_score, M.f1_score))
    with pytest.raises(ValueError):
        M.r2_score(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, prediction double"))


def test_scalers(spark):
    s = StandardScaler().fit(frame(spark, [1, 2, 3, 4, 5]))
    out = s.transform(frame(spark, [1, 2, 3, 4, 5]))
    assert np.allclose(column(s.inverse_transform(out), "features"), [[1], [2], [3], [4], [5]])
    assert column(StandardScaler().fit_transform(frame(spark, [5, 5, 5])), "features") == [[0.0]] * 3
    assert column(MinMaxScaler((2.0, 3.0)).fit_transform(frame(spark, [5, 5])), "features") == [[2.0]] * 2
    with pytest.raises(Exception, match="unseen"):
        OneHotEncoder().fit(frame(spark, [1], [0])).transform(frame(spark, [1], [9])).collect()
    with pytest.raises(ValueError):
        StandardScaler().fit(frame(spark, [1, float("nan")]))
    with pytest.raises(NotFittedError):
        StandardScaler().transform(frame(spark, [1]))


def test_linear_models(spark):
    m = LinearRegression().fit(frame(spark, [0, 1, 2, 3], [1, 3, 5, 7]))
    assert np.allclose([m.coef_[0], m.intercept_], [2, 1])
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = x @ rng.normal(size=5) + 0.3 * rng.normal(size=200) + 2
    df = frame(spark, x, y)
    a = np.column_stack([np.ones(200), x])
    want = np.linalg.lstsq(a, y, rcond=None)[0]
    m = LinearRegression().fit(df)
    assert np.allclose(np.r_[m.intercept_, m.coef_], want) and m.score(df) > 0.9
    g = LinearRegression(solver="gd", lr=0.1).fit(df)
    assert np.allclose(g.coef_, m.coef_, atol=1e-5)
    r = Ridge(3.0).fit(df)
    assert np.allclose(np.r_[r.intercept_, r.coef_], np.linalg.solve(a.T @ a + 3 * np.diag([0, 1, 1, 1, 1, 1]), a.T @ y))
    lasso = Lasso(0.1, tol=1e-10).fit(df)
    corr = (x - x.mean(0)).T @ (y - lasso.intercept_ - x @ lasso.coef_) / 200
    assert np.allclose(corr[lasso.coef_ != 0], 0.1 * np.sign(lasso.coef_[lasso.coef_ != 0]), atol=1e-6) and (np.abs(corr) <= 0.1 + 1e-6).all()
    double = np.column_stack([x, x[:, :1]])
    m = LinearRegression().fit(frame(spark, double, y))
    assert np.allclose(np.r_[m.intercept_, m.coef_], np.linalg.lstsq(np.column_stack([np.ones(200), double]), y, rcond=None)[0], atol=1e-8)


def test_binary_models(spark):
    df = generators.make_blobs(spark, 200, 2, 2, 1.2, random_state=0)
    m = LogisticRegression().fit(df)
    assert m.score(df) > 0.95 and abs(sum(m.predict_proba(df).first()["proba"]) - 1) < 1e-12
    with warnings.catch_warnings(record=True) as got:
        warnings.simplefilter("always")
        LogisticRegression(solver="gd", max_iter=2).fit(df)
        assert any(issubclass(w.category, ConvergenceWarning) for w in got)
    assert LinearSVM(max_iter=40).fit(df).score(df) > 0.95


def test_bayes_and_neighbours(spark):
    m = GaussianNB(var_smoothing=0.0).fit(frame(spark, [1, 2, 3, 10, 12], [0, 0, 0, 1, 1]))
    assert np.allclose(m.class_prior_, [0.6, 0.4]) and np.allclose(m.theta_.ravel(), [2, 11]) and np.allclose(m.var_.ravel(), [2 / 3, 1])
    df = frame(spark, [0, 1, 2, 3, 10], [1, 1, 0, 0, 0])
    assert KNeighborsClassifier(3).fit(df).predict(frame(spark, [1.0])).first()["prediction"] == 1
    near = KNeighborsClassifier(3, weights="distance").fit(df).predict_proba(frame(spark, [2.0])).first()["proba"]
    assert near == [1.0, 0.0]


def test_trees(spark):
    df = frame(spark, [0, 1, 2, 10, 11], [0, 0, 0, 1, 1])
    t = DecisionTreeClassifier().fit(df).tree_
    assert (t.feature[0], t.threshold[0]) == (0, 6.0)
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=(120, 3)), 1), rng.integers(3, size=120)
    s = np.eye(3)[y]
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, s)], "x array<double>, s array<double>")
    for rules in (Rules("gini", 4), Rules("entropy", 3, min_samples_leaf=4), Rules("gini", 3, min_impurity_decrease=0.01)):
        a, b = grow(rows, 3, 3, rules), grow_local(x, s, rules)
        assert np.allclose(a.value[a.leaves(x)], b.value[b.leaves(x)])
    z = np.sin(3 * x[:, 0]) + x[:, 1] ** 2
    m = DecisionTreeRegressor(max_depth=4).fit(frame(spark, x, z))
    twin = grow_local(x, np.stack([np.ones(120), z - z.mean(), (z - z.mean()) ** 2], 1), Rules("squared_error", 4))
    assert np.allclose(column(m.predict(frame(spark, x, z)), "prediction"), twin.value[twin.leaves(x), 0] + z.mean())
    assert [resolve_max_features(v, 10) for v in (None, "sqrt", "log2", 3, 0.5)] == [10, 3, 3, 3, 5]


def test_ensembles(spark):
    df = generators.make_moons(spark, 200, 0.2, random_state=0).persist()
    f = RandomForestClassifier(15, random_state=0, oob_score=True).fit(df)
    assert f.score(df) > 0.95 and f.oob_score_ > 0.85
    large = RandomForestClassifier(2, max_depth=3, random_state=0).fit(df, local_cells=0)
    assert large.score(df) > 0.8
    a = AdaBoostClassifier(3).fit(df)
    staged = list(a.staged_score(df))
    assert len(staged) == 3 and abs(staged[-1] - a.score(df)) < 1e-12
    g = GradientBoostingClassifier(n_estimators=2, max_depth=2).fit(df)
    assert g.score(df) > 0.8 and g.train_score_[1] < g.train_score_[0]
    assert GradientBoostingClassifier(n_estimators=1, subsample=0.5, random_state=0).fit(df).trees_[0][0].rows[0] == 100


def test_clusters(spark):
    x = [[0, 0], [0.1, 0], [0, 0.1], [0.1, 0.1], [0.35, 0.1], [5, 5]]
    m = DBSCAN(0.3, 4).fit(frame(spark, x))
    assert column(m.labels_, "label") == [0, 0, 0, 0, 0, -1] and sorted(r["row_id"] for r in m.core_sample_indices_.collect()) == [0, 1, 2, 3]
    df = generators.make_blobs(spark, 120, 2, 3, 0.5, random_state=3).persist()
    k = KMeans(3, n_init=3, random_state=0).fit(df)
    assert k.predict(df).groupBy("y").agg(F.countDistinct("prediction").alias("n")).agg(F.max("n")).first()[0] == 1
    for kind in ("full", "tied", "diag", "spherical"):
        g = GaussianMixture(3, covariance_type=kind, random_state=0).fit(df)
        assert g.converged_ and abs(g.weights_.sum() - 1) < 1e-9 and g.bic(df) > g.aic(df) - 1e-9


def test_pca(spark):
    m = PCA(1).fit(frame(spark, [[-2, -2], [-1, -1], [1, 1], [2, 2]]))
    assert np.allclose(m.components_[0], [2**-0.5] * 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 6)) @ rng.normal(size=(6, 6))
    df = frame(spark, x)
    m = PCA().fit(df)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(m.singular_values_, s) and np.allclose(np.abs(m.components_ @ vt.T), np.eye(6), atol=1e-6) and abs(m.score(df)) < 1e-9
    axes, values = power_iteration(np.cov(x, rowvar=False), 2, rng)
    assert np.allclose(values, m.explained_variance_[:2], rtol=1e-4)


def test_optimizers():
    p = [np.array([1.0])]
    O.Adam(0.1).step(p, [np.array([2.0])])
    assert np.allclose(p[0], 0.9)
    for o in (O.SGD(0.01), O.Momentum(0.01), O.Nesterov(0.01), O.RMSprop(0.05), O.Adam(0.1)):
        p, a = [np.array([3.0, -2.0, 1.0])], np.array([1.0, 5.0, 20.0])
        for _ in range(300):
            o.step(p, [a * p[0]])
        assert (a * p[0] ** 2).sum() < 1
    with pytest.raises(ValueError):
        O.Momentum(momentum=1.0)


def gradient(f, x, eps=1e-6):
    out = np.zeros_like(x)
    for k in np.ndindex(x.shape):
        old = x[k]
        x[k] = old + eps
        a = f()
        x[k] = old - eps
        b = f()
        x[k] = old
        out[k] = (a - b) / (2 * eps)
    return out


@pytest.mark.parametrize("layer, shape", [(N.Linear(4, 3, random_state=0), (5, 4)), (N.BatchNorm1d(4), (5, 4)), (N.Conv2d(2, 3, (2, 3), 1, 1, random_state=0), (1, 2, 4, 5)), (N.MaxPool2d(2, 1, 1), (2, 2, 4, 4)), (N.Softmax(), (3, 4)), (N.Tanh(), (3, 4)), (N.RNN(2, 3, random_state=0), (2, 4, 2)), (N.LSTM(2, 3, random_state=0), (2, 4, 2))])
def test_backward_is_the_derivative(layer, shape):
    rng = np.random.default_rng(0)
    x = rng.normal(size=shape)
    first = lambda o: o[0] if isinstance(o, tuple) else o
    w = rng.normal(size=first(layer.forward(x)).shape)
    value = lambda: (first(layer.forward(x)) * w).sum()
    layer.forward(x)
    got = first(layer.backward(w))
    grads = [g.copy() for g in layer.grads()]
    assert np.allclose(got, gradient(value, x), atol=1e-5)
    for p, g in zip(layer.parameters(), grads):
        assert np.allclose(g, gradient(value, p), atol=1e-5)


def test_layer_fixtures(spark):
    c = N.Conv2d(1, 1, 2)
    c.W[:], c.b[:] = 1, 1
    assert c.forward(np.arange(1.0, 10).reshape(1, 1, 3, 3)).tolist() == [[[[13, 17], [25, 29]]]]
    pool = N.MaxPool2d(2)
    pool.forward(np.array([[[[2.0, 2], [1, 0]]]]))
    assert pool.backward(np.ones((1, 1, 1, 1))).tolist() == [[[[1, 0], [0, 0]]]]
    cell = N.RNNCell(1, 1)
    cell.W_ih[:], cell.W_hh[:], cell.b[:] = 2, 3, 0.5
    assert np.allclose(cell.forward(np.ones((1, 1)), np.full((1, 1), 0.1)), np.tanh(2.8))
    lstm = N.LSTMCell(1, 1, weight_init="zeros")
    h, state = lstm.forward(np.zeros((1, 1)), (np.zeros((1, 1)), np.full((1, 1), 2.0)))
    assert np.allclose(state, 1) and np.allclose(h, 0.5 * np.tanh(1))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = (x[:, :1] * x[:, 1:] > 0).astype(float)
    history = N.Trainer([N.Linear(2, 16, random_state=0), N.ReLU(), N.Linear(16, 1, random_state=1)], N.BCEWithLogitsLoss(), O.Adam(0.05)).fit(x, y, 60, 20, random_state=0)
    assert history["train_loss"][-1] < 0.2 * history["train_loss"][0]
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, target array<double>")
    make = lambda: N.Trainer([N.Linear(2, 3, random_state=0), N.Tanh(), N.Linear(3, 1, random_state=1)], N.MSELoss(), O.SGD(0.1))
    assert np.allclose(make().fit_distributed(df, 3), make().fit(x, y, 3, 60, shuffle=False)["train_loss"])


def test_tokenizers(spark):
    df = spark.createDataFrame([(1, "cabac")], "doc_id long, text string")
    tok = CharTokenizer().fit(df)
    assert tok.vocabulary_ == ["a", "b", "c"] and tok.encode(df).first()["ids"] == [2, 0, 1, 0, 2]
    assert BPETokenizer(2).fit(spark.createDataFrame([("abab",)], "text string")).merges_ == [("a", "b"), ("ab", "ab")]
    assert BPETokenizer(1).fit(spark.createDataFrame([("abac",)], "text string")).merges_ == [("a", "b")]
    with pytest.raises(Exception, match="unknown"):
        tok.encode(spark.createDataFrame([("xyz",)], "text string")).collect()
    for tokens in (list("aaaa"), list("aaabaa"), list("abcab"), ["aa", "a"], list("baab")):
        for pair in (("a", "a"), ("a", "b")):
            got = replace_pair(spark.createDataFrame([(tokens, 1)], "ts array<string>, n long"), *pair).first()["ts"]
            assert got == merge_once(tokens, *pair)


def test_sources(spark, tmp_path):
    images = struct.pack(">IIII", 2051, 2, 2, 2) + bytes(range(8))
    labels = struct.pack(">II", 2049, 2) + bytes([7, 3])
    for a, b in files.MNIST_FILES.values():
        (tmp_path / a).write_bytes(gzip.compress(images))
        (tmp_path / b).write_bytes(gzip.compress(labels))
    got = files.load_mnist(spark, str(tmp_path), download=False)["train"].orderBy("row_id").collect()
    assert [r.y for r in got] == [7, 3] and np.allclose(got[1].features, np.array([4, 5, 6, 7]) / 255)
    with pytest.raises(ValueError):
        files.parse_idx_labels(images)
    with pytest.raises(FileNotFoundError):
        files.load_mnist(spark, str(tmp_path / "none"), download=False)
    files.save_parameters(spark, [np.eye(2), np.arange(3.0)], str(tmp_path / "p"))
    assert np.array_equal(files.load_parameters(spark, str(tmp_path / "p"))[0], np.eye(2))


def test_stream_of_batches(spark, tmp_path):
    df = generators.make_blobs(spark, 60, 2, 2, random_state=0)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    running = RunningMoments()
    q = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(running).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    x = np.array([r["features"] for r in df.collect()])
    assert running.moments.n == 60 and np.allclose(running.moments.mean, x.mean(0)) and np.allclose(running.moments.scatter, (x - x.mean(0)).T @ (x - x.mean(0)))
