"""Queries over the provided tables, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import expr, streams
from quillon.functions.base import feature_columns
from quillon.functions.held import shared_folder
from quillon.functions.stats import sums
from quillon.operators import metrics as M
from quillon.operators import optimizers as O
from quillon.operators.bayes import GaussianNB
from quillon.operators.cluster import DBSCAN, GaussianMixture, KMeans
from quillon.operators.decomposition import PCA
from quillon.operators.ensemble import POISSON, AdaBoostClassifier, GradientBoostingClassifier, RandomForestClassifier
from quillon.operators.layers import LSTM, RNN, Linear, MSELoss, Tanh, Trainer
from quillon.operators.linear import Lasso, LinearRegression, LinearSVM, LogisticRegression, Ridge
from quillon.operators.neighbors import KNeighborsClassifier
from quillon.operators.preprocessing import MinMaxScaler, OneHotEncoder, SparseOneHotEncoder, StandardScaler, train_test_split
from quillon.operators.tokenizers import BPETokenizer, CharTokenizer, adjacent_pairs, characters
from quillon.operators.tree import DecisionTreeClassifier, DecisionTreeRegressor, apply_kernel
from quillon.sources import generators
from quillon.streaming import keyed
from quillon.tensor import autodiff as ad
from quillon.tensor import rel, tiles
from quillon.tensor import transformer as tf

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str, digits: int = 6):
    """Rounded, without the sign of zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in values.items()])


def vectors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("features"), F.col("label").cast("long").alias("y"))


def long_vectors(spark, sf) -> DataFrame:
    """(n, i, v) of the embeddings."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("i", "v"))


LONG = "SELECT vec_id AS n, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v, label FROM embeddings"


def prices(spark, sf) -> DataFrame:
    return feature_columns(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]).select("features", F.col("l_extendedprice").alias("y"))


def returned(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"), (F.col("l_returnflag") == "R").cast("long").alias("y"))


RETURNED = "SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, (l_returnflag = 'R')::INT AS y FROM lineitem"


def graded(spark, sf) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double")).alias("features"), F.col("quality").cast("long").alias("y"))


def places(spark, sf) -> DataFrame:
    """Customers in the plane: balance in thousands, and nation; the class is the segment's number in order."""
    df = table(spark, sf, "customer")
    segments = df.select("c_mktsegment").distinct().withColumn("y", F.dense_rank().over(Window.orderBy("c_mktsegment")).cast("long"))
    return df.join(segments, "c_mktsegment").select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("features"), "y")


PLACES = "SELECT c_custkey AS id, c_acctbal / 1000 AS x1, c_nationkey::DOUBLE AS x2, dense_rank() OVER (ORDER BY c_mktsegment) AS y FROM customer"

# --- naive Bayes and neighbours ---------------------------------------------------------------------------------------

NB_STATS = f"""WITH l AS ({LONG}), s AS (SELECT label, i, avg(v) AS m, var_pop(v) AS var FROM l GROUP BY 1, 2),
e AS (SELECT 1e-9 * max(p) AS eps FROM (SELECT var_pop(v) AS p FROM l GROUP BY i)), c AS (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1)"""


@query(NB_STATS + " SELECT label::BIGINT AS label, i::BIGINT AS i, round(m, 6) + 0.0 AS mean, round(var + eps, 6) AS variance, n::BIGINT AS n FROM s JOIN c USING (label), e")
def gaussian_nb_fit(spark, sf):
    m = GaussianNB().fit(vectors(spark, sf))
    rows = [(int(c), i, float(m.theta_[k, i]), float(m.var_[k, i]), int(m.class_count_[k])) for k, c in enumerate(m.classes_) for i in range(m.theta_.shape[1])]
    df = spark.createDataFrame(rows, "label long, i long, mean double, variance double, n long")
    return df.select("label", "i", r6("mean", "mean"), r6("variance", "variance"), "n")


NB_JLL = NB_STATS + """, j AS (SELECT l.n AS id, s.label, any_value(l.label) AS y, ln(any_value(c.n) / (SELECT count(*) FROM embeddings)) + sum(-0.5 * ln(2 * pi() * (var + eps)) - (v - m) * (v - m) / (2 * (var + eps))) AS jll
FROM l JOIN s ON l.i = s.i JOIN c ON c.label = s.label, e GROUP BY 1, 2)"""


@query(NB_JLL + ", p AS (SELECT id, y, arg_max(label, jll) AS p, max(jll) AS top FROM j GROUP BY 1, 2), z AS (SELECT j.id, sum(exp(jll - top)) AS z FROM j JOIN p ON p.id = j.id GROUP BY 1) SELECT p.id AS row_id, p.p::BIGINT AS prediction, round(1 / z, 6) AS proba FROM p JOIN z ON p.id = z.id")
def gaussian_nb_predict(spark, sf):
    df = vectors(spark, sf)
    m = GaussianNB().fit(df)
    return m.predict(m.predict_proba(df)).select("row_id", "prediction", r6(F.array_max("proba"), "proba"))


@query(NB_JLL + ", p AS (SELECT id, y, arg_max(label, jll) AS p FROM j GROUP BY 1, 2) SELECT round(avg((p = y)::INT), 6) AS accuracy FROM p")
def gaussian_nb_score(spark, sf):
    df = vectors(spark, sf)
    return GaussianNB().fit(df).predict(df).agg(r6(M.accuracy("y", "prediction"), "accuracy"))


@query(f"""WITH t AS ({PLACES}), q AS (SELECT s_suppkey AS q, s_acctbal / 1000 AS x1, s_nationkey::DOUBLE AS x2 FROM supplier),
d AS (SELECT q, id, y, sqrt((t.x1 - q.x1) * (t.x1 - q.x1) + (t.x2 - q.x2) * (t.x2 - q.x2)) AS d FROM q, t),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM d QUALIFY r <= 5),
v AS (SELECT q, y, count(*) AS n FROM k GROUP BY 1, 2)
SELECT q AS row_id, arg_max(y, n * 1000 - y)::BIGINT AS prediction, round(max(n) / 5, 6) AS share FROM v GROUP BY 1""")
def knn_classify(spark, sf):
    m = KNeighborsClassifier(5).fit(places(spark, sf))
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("features"))
    return m.predict_both(q).select("row_id", "prediction", r6(F.array_max("proba"), "share"))


@query(f"""WITH t AS ({PLACES}), q AS (SELECT o_orderkey AS q, o_totalprice / 50000 AS x1, (o_custkey % 25)::DOUBLE AS x2 FROM orders WHERE o_orderkey % 100 = 0),
d AS (SELECT q, id, y, sqrt((t.x1 - q.x1) * (t.x1 - q.x1) + (t.x2 - q.x2) * (t.x2 - q.x2)) AS d FROM q, t),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM d QUALIFY r <= 7),
v AS (SELECT q, y, sum(CASE WHEN z = 0 THEN (d = 0)::INT ELSE 1 / d END) AS w FROM (SELECT *, min(d) OVER (PARTITION BY q) AS z FROM k) GROUP BY 1, 2)
SELECT q AS row_id, arg_max(y, w)::BIGINT AS prediction, round(max(w) / sum(w), 6) AS share FROM v GROUP BY 1""")
def knn_distance_weights(spark, sf):
    """Votes by inverse distance; the queries are the orders whose key is divisible by 100, against all customers."""
    m = KNeighborsClassifier(7, weights="distance").fit(places(spark, sf))
    o = table(spark, sf, "orders").where("o_orderkey % 100 = 0")
    q = o.select(F.col("o_orderkey").alias("row_id"), F.array(F.col("o_totalprice") / 50000, (F.col("o_custkey") % 25).cast("double")).alias("features"))
    return m.predict_both(q).select("row_id", "prediction", r6(F.array_max("proba"), "share"))


@query(f"""WITH t AS ({PLACES}), q AS (SELECT s_suppkey AS q, s_acctbal / 1000 AS x1, s_nationkey::DOUBLE AS x2 FROM supplier),
d AS (SELECT q, id, abs(t.x1 - q.x1) + abs(t.x2 - q.x2) AS d FROM q, t)
SELECT q AS row_id, id AS train_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM d QUALIFY rank <= 3""")
def knn_neighbors_manhattan(spark, sf):
    m = KNeighborsClassifier(3, metric="manhattan").fit(places(spark, sf))
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("features"))
    return m.kneighbors(q).select("row_id", "train_id", r6("distance", "distance"), F.col("rank").cast("long").alias("rank"))


# --- metrics ----------------------------------------------------------------------------------------------------------

GUESS = "SELECT quality AS y, (n_chars > 1000)::INT AS p FROM documents JOIN labels USING (doc_id)"


def guesses(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("prediction"))


@query(f"WITH g AS ({GUESS}), a AS (SELECT y AS l FROM g UNION SELECT p FROM g) SELECT a.l::BIGINT AS y_true, b.l::BIGINT AS y_pred, count(g.y) AS n FROM a CROSS JOIN a b LEFT JOIN g ON g.y = a.l AND g.p = b.l GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(guesses(spark, sf))


@query(f"""WITH c AS (SELECT avg((y = p)::INT) AS a, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn FROM ({GUESS}))
SELECT round(a, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def classification_scores(spark, sf):
    return guesses(spark, sf).agg(r6(M.accuracy("y", "prediction"), "accuracy"), r6(M.precision(), "precision"), r6(M.recall(), "recall"), r6(M.f1(), "f1"))


@query("""SELECT round(avg(d * d), 2) AS mse, round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d)), 4) AS mae, round(1 - avg(d * d) / any_value(v), 6) AS r2
FROM (SELECT l_extendedprice - l_quantity * 1500 AS d, var_pop(l_extendedprice) OVER () AS v FROM lineitem)""")
def regression_scores(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("prediction"))
    return df.agg(r6(M.mean_squared_error(), "mse", 2), r6(M.root_mean_squared_error(), "rmse", 4), r6(M.mean_absolute_error(), "mae", 4), r6(M.r2(), "r2"))


CENTRES = f"WITH l AS ({LONG}), c AS (SELECT label, i, avg(v) AS m FROM l GROUP BY 1, 2)"


def to_centres(spark, sf, metric, into):
    df = vectors(spark, sf)
    means = df.select("y", F.posexplode("features").alias("i", "v")).groupBy("y", "i").agg(F.avg("v").alias("v")).groupBy("y").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("b"))
    return metric(df.select(F.col("row_id").alias("a_id"), F.col("features").alias("a")), means.select(F.col("y").alias("b_id"), "b")).select("a_id", "b_id", r6(into, into))


@query(CENTRES + " SELECT n AS a_id, c.label::BIGINT AS b_id, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM l JOIN c USING (i) GROUP BY 1, 2")
def pairwise_euclidean(spark, sf):
    return to_centres(spark, sf, M.euclidean_distance, "distance")


@query(CENTRES + " SELECT n AS a_id, c.label::BIGINT AS b_id, round(sum(abs(v - m)), 6) AS distance FROM l JOIN c USING (i) GROUP BY 1, 2")
def pairwise_manhattan(spark, sf):
    return to_centres(spark, sf, M.manhattan_distance, "distance")


@query(CENTRES + " SELECT n AS a_id, c.label::BIGINT AS b_id, round(sum(v * m) / sqrt(sum(v * v)) / sqrt(sum(m * m)), 6) + 0.0 AS similarity FROM l JOIN c USING (i) GROUP BY 1, 2")
def pairwise_cosine(spark, sf):
    return to_centres(spark, sf, M.cosine_similarity, "similarity")


# --- preprocessing ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) + 0.0 AS scaled FROM orders")
def standard_scaler(spark, sf):
    df = feature_columns(table(spark, sf, "orders"), ["o_totalprice"])
    return StandardScaler().fit_transform(df).select("o_orderkey", r6(F.get("features", F.lit(0)), "scaled"))


@query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) * 2 - 1, 6) + 0.0 AS scaled FROM orders")
def min_max_scaler(spark, sf):
    df = feature_columns(table(spark, sf, "orders"), ["o_totalprice"])
    return MinMaxScaler((-1.0, 1.0)).fit_transform(df).select("o_orderkey", r6(F.get("features", F.lit(0)), "scaled"))


@query("""WITH c AS (SELECT DISTINCT c_mktsegment AS s FROM customer) SELECT c_custkey, s AS category, (s = c_mktsegment)::INT::DOUBLE AS hot, c_mktsegment AS back FROM customer, c""")
def one_hot_encoder(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    enc = OneHotEncoder()
    out = enc.inverse_transform(enc.fit_transform(df, "c_mktsegment"), into="back")
    names = F.array(*[F.lit(c) for c in enc.categories_])
    return out.select("c_custkey", F.explode(F.arrays_zip(names.alias("category"), F.col("one_hot").alias("hot"))).alias("z"), "back").select("c_custkey", "z.category", "z.hot", "back")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || ':7'), o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k <= round_even(n * 0.25, 0) THEN 'test' ELSE 'train' END AS side FROM r""")
def exact_split(spark, sf):
    train, test = train_test_split(table(spark, sf, "orders").select("o_orderkey"), 0.25, 7, "o_orderkey")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("""WITH d AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS index, o_custkey FROM orders) SELECT o_orderkey, (SELECT count(DISTINCT o_custkey) FROM orders) AS size, index, 1.0::DOUBLE AS value, o_custkey AS back FROM d""")
def sparse_one_hot(spark, sf):
    """Orders by customer: a label for each customer, and back."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    enc = SparseOneHotEncoder()
    out = enc.inverse_transform(enc.fit_transform(df, "o_custkey"), into="back")
    return out.select("o_orderkey", F.col("one_hot.size").alias("size"), F.get("one_hot.indices", F.lit(0)).alias("index"), F.get("one_hot.values", F.lit(0)).alias("value"), "back")


DRAW = "(('0x' || substr(md5(c_custkey || ':11:' || {n}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


@query(f"WITH u AS (SELECT c_custkey, {', '.join(f'{DRAW.format(n=n)} AS u{n}' for n in range(6))} FROM customer) SELECT c_custkey, round(u4, 9) AS uniform, round(sqrt(-2 * ln(u0)) * cos(2 * pi() * u1), 6) + 0.0 AS z0, round(sqrt(-2 * ln(u2)) * cos(2 * pi() * u3), 6) + 0.0 AS z1 FROM u")
def random_streams(spark, sf):
    """A uniform and two normal draws for each customer."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", r6(streams.uniform(key, 11, 4), "uniform", 9), r6(streams.normal(key, 11, 0), "z0"), r6(streams.normal(key, 11, 1), "z1"))


# --- linear models ----------------------------------------------------------------------------------------------------

NORMAL = """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS m, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS bq FROM lineitem),
w AS (SELECT *, (ay * (bb + {l}) - bq * ab) / ((aa + {l}) * (bb + {l}) - ab * ab) AS w1, (bq * (aa + {l}) - ay * ab) / ((aa + {l}) * (bb + {l}) - ab * ab) AS w2 FROM s)
SELECT round(w1, 4) AS w1, round(w2, 4) AS w2, round(m - w1 * a - w2 * b, 3) AS intercept FROM w"""


def fitted(spark, m, digits=4):
    out = one_row(spark, w1=m.coef_[0], w2=m.coef_[1], intercept=m.intercept_)
    return out.select(r6("w1", "w1", digits), r6("w2", "w2", digits), r6("intercept", "intercept", digits - 1))


@query(NORMAL.format(l="0"))
def linear_regression(spark, sf):
    return fitted(spark, LinearRegression().fit(prices(spark, sf)))


@query(NORMAL.format(l="(1000.0 / n)"))
def ridge_regression(spark, sf):
    return fitted(spark, Ridge(1000.0).fit(prices(spark, sf)))


@query("""WITH s AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS m, var_pop(l_quantity) AS v, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem),
w AS (SELECT *, sign(c) * greatest(abs(c) - 5000, 0) / v AS w FROM s) SELECT round(w, 4) + 0.0 AS w1, round(m - w * a, 3) AS intercept FROM w""")
def lasso_regression(spark, sf):
    df = feature_columns(table(spark, sf, "lineitem"), ["l_quantity"]).withColumnRenamed("l_extendedprice", "y")
    m = Lasso(5000.0).fit(df)
    return one_row(spark, w1=m.coef_[0], intercept=m.intercept_).select(r6("w1", "w1", 4), r6("intercept", "intercept", 3))


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b, regr_r2(l_extendedprice, l_quantity) AS r FROM lineitem)
SELECT round(avg(w * l_quantity + b), 3) AS mean_prediction, round(max(w * l_quantity + b), 3) AS max_prediction, round(any_value(r), 6) AS r2 FROM lineitem, s""")
def linear_predict_and_score(spark, sf):
    df = feature_columns(table(spark, sf, "lineitem"), ["l_quantity"]).withColumnRenamed("l_extendedprice", "y")
    out = LinearRegression().fit(df).predict(df)
    return out.agg(r6(F.avg("prediction"), "mean_prediction", 3), r6(F.max("prediction"), "max_prediction", 3), r6(M.r2(), "r2"))


def gd_sql(steps: int, rate: float) -> str:
    parts = ["p0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"]
    for k in range(1, steps + 1):
        parts.append(f"p{k} AS (SELECT any_value(b) - {rate} * avg(e) AS b, any_value(w1) - {rate} * (sum(e * x1) + any_value(w1)) / count(*) AS w1, any_value(w2) - {rate} * (sum(e * x2) + any_value(w2)) / count(*) AS w2 FROM (SELECT *, 1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) - y AS e FROM d, p{k - 1}))")
    return f"WITH d AS ({RETURNED}), " + ", ".join(parts) + f" SELECT round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2, round(b, 5) + 0.0 AS intercept FROM p{steps}"


@query(gd_sql(4, 0.5))
def logistic_gradient_descent(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return fitted(spark, LogisticRegression(solver="gd", lr=0.5, max_iter=4, tol=1e-30).fit(returned(spark, sf)), 6)


SCALED = "SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, l_extendedprice / 10000 AS y FROM lineitem"


def scaled(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"), (F.col("l_extendedprice") / 10000).alias("y"))


def scored(spark, models, df) -> DataFrame:
    rows = [(name, float(m.coef_[0]), float(m.coef_[1]), float(m.intercept_), float(m.score(df))) for name, m in models]
    out = spark.createDataFrame(rows, "model string, w1 double, w2 double, intercept double, r2 double")
    return out.select("model", *[r6(c, c) for c in ("w1", "w2", "intercept", "r2")])


def descent_sql(name: str, steps: int, rate: float, alpha: float) -> str:
    parts = [f"{name}0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"]
    for k in range(1, steps + 1):
        parts.append(f"{name}{k} AS (SELECT any_value(b) - 2 * {rate} * avg(e) AS b, any_value(w1) - 2 * {rate} * (sum(e * x1) + {alpha} * any_value(w1)) / count(*) AS w1, any_value(w2) - 2 * {rate} * (sum(e * x2) + {alpha} * any_value(w2)) / count(*) AS w2 FROM (SELECT *, b + w1 * x1 + w2 * x2 - y AS e FROM d, {name}{k - 1}))")
    return ", ".join(parts)


def model_sql(model: str, fitted: str) -> str:
    return f"SELECT '{model}' AS model, round(any_value(w1), 6) + 0.0 AS w1, round(any_value(w2), 6) + 0.0 AS w2, round(any_value(b), 6) + 0.0 AS intercept, round(1 - sum((y - b - w1 * x1 - w2 * x2) * (y - b - w1 * x1 - w2 * x2)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2 FROM d, {fitted}"


@query(f"WITH d AS ({SCALED}), {descent_sql('p', 6, 0.2, 0)}, {descent_sql('q', 6, 0.2, 500.0)} {model_sql('linear', 'p6')} UNION ALL {model_sql('ridge', 'q6')}")
def gradient_descent_regressors(spark, sf):
    """Six steps of gradient descent for least squares and ridge, and how well they then predict."""
    df = scaled(spark, sf)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        models = [("linear", LinearRegression(solver="gd", lr=0.2, max_iter=6, tol=0.0).fit(df)), ("ridge", Ridge(500.0, solver="gd", lr=0.2, max_iter=6, tol=0.0).fit(df))]
    return scored(spark, models, df)


def lasso_sql(sweeps: int, alpha: float) -> str:
    soft = lambda r: f"sign({r}) * greatest(abs({r}) - {alpha}, 0)"
    parts = ["s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS g11, var_pop(x2) AS g22, covar_pop(x1, x2) AS g12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM d)", "l0 AS (SELECT *, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM s)"]
    for k in range(sweeps):
        parts.append(f"h{k} AS (SELECT * REPLACE ({soft('(c1 - g12 * w2)')} / g11 AS w1) FROM l{k})")
        parts.append(f"l{k + 1} AS (SELECT * REPLACE ({soft('(c2 - g12 * w1)')} / g22 AS w2) FROM h{k})")
    return ", ".join(parts) + f", lasso AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b FROM l{sweeps})"


@query(f"WITH d AS ({SCALED}), {lasso_sql(3, 0.05)}, r AS (SELECT (c1 * (g22 + l) - c2 * g12) / ((g11 + l) * (g22 + l) - g12 * g12) AS w1, (c2 * (g11 + l) - c1 * g12) / ((g11 + l) * (g22 + l) - g12 * g12) AS w2, * EXCLUDE (l) FROM (SELECT *, 100.0 / (SELECT count(*) FROM d) AS l FROM s)), "
       f"ridge AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b FROM r) {model_sql('lasso', 'lasso')} UNION ALL {model_sql('ridge', 'ridge')}")  # fmt: skip
def regressor_scores(spark, sf):
    """Lasso after three sweeps and ridge by its normal equations, with their scores."""
    df = scaled(spark, sf)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        models = [("lasso", Lasso(0.05, max_iter=3, tol=0.0).fit(df)), ("ridge", Ridge(100.0).fit(df))]
    return scored(spark, models, df)


def newton_sql(steps: int) -> str:
    """Newton steps for p<k>(b, w1, w2), each taken while half the decrement is at least the tolerance; 3 x 3 systems by Cramer's rule."""
    det = lambda m: f"(({m[0]}) * (({m[4]}) * ({m[8]}) - ({m[5]}) * ({m[7]})) - ({m[1]}) * (({m[3]}) * ({m[8]}) - ({m[5]}) * ({m[6]})) + ({m[2]}) * (({m[3]}) * ({m[7]}) - ({m[4]}) * ({m[6]})))"
    h = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"]
    swap = lambda j: [f"g{i // 3}" if i % 3 == j else x for i, x in enumerate(h)]
    parts = ["p0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, false AS done)"]
    for k in range(steps):
        parts.append(f"""s{k} AS (SELECT any_value(b) AS b, any_value(w1) AS w1, any_value(w2) AS w2, any_value(done) AS done, avg(e) AS g0, (sum(e * x1) + any_value(w1)) / count(*) AS g1, (sum(e * x2) + any_value(w2)) / count(*) AS g2,
avg(v) AS h00, avg(v * x1) AS h01, avg(v * x2) AS h02, (sum(v * x1 * x1) + 1) / count(*) AS h11, avg(v * x1 * x2) AS h12, (sum(v * x2 * x2) + 1) / count(*) AS h22
FROM (SELECT *, q - y AS e, q * (1 - q) AS v FROM (SELECT *, 1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) AS q FROM d, p{k})))""")
        parts.append(f"t{k} AS (SELECT *, {det(swap(0))} / {det(h)} AS d0, {det(swap(1))} / {det(h)} AS d1, {det(swap(2))} / {det(h)} AS d2 FROM s{k})")
        parts.append(f"u{k} AS (SELECT *, done OR 0.5 * (g0 * d0 + g1 * d1 + g2 * d2) < 1e-6 AS stop FROM t{k})")
        parts.append(f"p{k + 1} AS (SELECT CASE WHEN stop THEN b ELSE b - d0 END AS b, CASE WHEN stop THEN w1 ELSE w1 - d1 END AS w1, CASE WHEN stop THEN w2 ELSE w2 - d2 END AS w2, stop AS done FROM u{k})")
    return ", ".join(parts)


@query(f"WITH d AS ({RETURNED}), {newton_sql(6)}, r AS (SELECT 1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) AS q FROM d, p6) SELECT (q >= 0.5)::BIGINT AS prediction, count(*) AS n, round(avg(q), 6) AS mean_proba FROM r GROUP BY 1")
def logistic_newton(spark, sf):
    df = returned(spark, sf)
    m = LogisticRegression().fit(df)
    return m.predict_proba(m.predict(df)).groupBy("prediction").agg(F.count("*").alias("n"), r6(F.avg(F.get("proba", F.lit(1))), "mean_proba"))


def svm_sql(steps: int, c: float, rate: float) -> str:
    parts = ["p1 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"]
    for k in range(1, steps + 2):
        parts.append(f"g{k} AS (SELECT any_value(b) AS b, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w1 * w1 + w2 * w2) / 2 + {c} * sum(greatest(1 - m, 0)) AS j, sum(CASE WHEN m < 1 THEN s * x1 ELSE 0 END) AS a1, sum(CASE WHEN m < 1 THEN s * x2 ELSE 0 END) AS a2, sum(CASE WHEN m < 1 THEN s ELSE 0 END) AS a0 FROM (SELECT *, s * (b + w1 * x1 + w2 * x2) AS m FROM (SELECT *, 2 * y - 1 AS s FROM d), p{k}))")
        parts.append(f"p{k + 1} AS (SELECT b + {rate} / sqrt({k}) * {c} * a0 AS b, w1 - {rate} / sqrt({k}) * (w1 - {c} * a1) AS w1, w2 - {rate} / sqrt({k}) * (w2 - {c} * a2) AS w2 FROM g{k})")
    every = " UNION ALL ".join(f"SELECT {k} AS k, j, b, w1, w2 FROM g{k}" for k in range(1, steps + 2))
    return f"WITH d AS ({RETURNED}), " + ", ".join(parts) + f" SELECT round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2, round(b, 5) + 0.0 AS intercept FROM ({every}) ORDER BY j, k LIMIT 1"


@query(svm_sql(5, 0.001, 0.01))
def linear_svm(spark, sf):
    return fitted(spark, LinearSVM(C=0.001, lr=0.01, max_iter=5).fit(returned(spark, sf)), 6)


@query(svm_sql(5, 0.001, 0.01).replace(" SELECT round(w1, 6)", ", best AS (SELECT b, w1, w2 FROM (", 1).split(", best AS")[0] + ", best AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, j, b, w1, w2 FROM g{k}" for k in range(1, 7)) + ") ORDER BY j, k LIMIT 1), r AS (SELECT y, b + w1 * x1 + w2 * x2 AS z FROM d, best) SELECT round(avg(z), 6) + 0.0 AS mean_decision, round(min(z), 6) + 0.0 AS least, round(max(z), 6) + 0.0 AS greatest, count(*) FILTER (z >= 0) AS positive, round(avg(((z >= 0)::INT = y)::INT), 6) AS accuracy FROM r")
def linear_svm_decision(spark, sf):
    df = returned(spark, sf)
    m = LinearSVM(C=0.001, lr=0.01, max_iter=5).fit(df)
    out = m.predict(m.decision_function(df))
    return out.agg(r6(F.avg("decision"), "mean_decision"), r6(F.min("decision"), "least"), r6(F.max("decision"), "greatest"), F.sum("prediction").alias("positive"), r6(M.accuracy("y", "prediction"), "accuracy"))


# --- trees and ensembles ----------------------------------------------------------------------------------------------

GRADED = "SELECT d.doc_id, n_chars::DOUBLE AS f0, d.doc_id::DOUBLE AS f1, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
GINI = "CASE WHEN ({n}) > 0 THEN 1 - pow(({a})::DOUBLE / ({n}), 2) - pow((({n}) - ({a}))::DOUBLE / ({n}), 2) ELSE 0 END"
ROOT = f"""WITH d AS ({GRADED}), u AS (SELECT 0 AS f, f0 AS v, y FROM d UNION ALL SELECT 1, f1, y FROM d),
e AS (SELECT f, v, count(*) AS n, sum(y) AS a FROM u GROUP BY 1, 2),
w AS (SELECT f, v, lead(v) OVER o AS nx, sum(n) OVER o AS ln, sum(a) OVER o AS la, sum(n) OVER (PARTITION BY f) AS tn, sum(a) OVER (PARTITION BY f) AS ta FROM e WINDOW o AS (PARTITION BY f ORDER BY v)),
g AS (SELECT *, (v + nx) / 2 AS cut, {GINI.format(n='tn', a='ta')} - (ln * ({GINI.format(n='ln', a='la')}) + (tn - ln) * ({GINI.format(n='tn - ln', a='ta - la')})) / tn AS gain FROM w WHERE nx IS NOT NULL),
b AS (SELECT * FROM g ORDER BY round(gain, 11) DESC, f, cut LIMIT 1)"""


@query(ROOT + " SELECT f::BIGINT AS feature, cut AS threshold, round(gain, 8) AS gain, ln::BIGINT AS n_left, tn::BIGINT AS n FROM b")
def decision_tree_root(spark, sf):
    t = DecisionTreeClassifier(max_depth=1).fit(graded(spark, sf)).tree_
    from quillon.operators.tree import impurity

    s = [np.array(x) for x in t.stats]
    gain = impurity(s[0], "gini") - (s[1].sum() * impurity(s[1], "gini") + s[2].sum() * impurity(s[2], "gini")) / s[0].sum()
    return spark.createDataFrame([(t.feature[0], float(t.threshold[0]), float(gain), t.rows[1], t.rows[0])], "feature long, threshold double, gain double, n_left long, n long").withColumn("gain", F.round("gain", 8))


@query(ROOT + """, p AS (SELECT d.doc_id, CASE WHEN (CASE WHEN b.f = 0 THEN f0 ELSE f1 END) <= b.cut THEN (la * 2 > ln)::INT ELSE ((ta - la) * 2 > (tn - ln))::INT END AS p, y FROM d, b),
x AS (SELECT avg((p <> y)::INT) AS err FROM p) SELECT round(err, 6) AS error, round(ln((1 - err) / err), 6) AS alpha FROM x""")
def adaboost_first_round(spark, sf):
    m = AdaBoostClassifier(1).fit(graded(spark, sf))
    return one_row(spark, error=m.estimator_errors_[0], alpha=m.estimator_weights_[0]).select(r6("error", "error"), r6("alpha", "alpha"))


def tree_sql(depth: int, d: int, criterion: str, name: str = "", min_leaf: int = 1, draw: tuple | None = None) -> str:
    """CTEs that grow trees from {name}r0(t, node, c, w, y, x0, ...), a row for each row and tree, to {name}r<depth>.

    Nodes are numbered from 1, the children of k are 2k and 2k + 1. draw = (seed, features tried at a node).
    """
    share = lambda p: f"(CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0 END)"
    of = {
        "gini": lambda n, a, q: f"(CASE WHEN ({n}) > 0 THEN 1 - pow(({a}) / ({n}), 2) - pow((({n}) - ({a})) / ({n}), 2) ELSE 0 END)",
        "entropy": lambda n, a, q: f"(CASE WHEN ({n}) > 0 THEN {share(f'(({a}) / ({n}))')} + {share(f'((({n}) - ({a})) / ({n}))')} ELSE 0 END)",
        "squared_error": lambda n, a, q: f"(CASE WHEN ({n}) > 0 THEN greatest(({q}) / ({n}) - pow(({a}) / ({n}), 2), 0) ELSE 0 END)",
    }[criterion]
    whole, left, right = of("tn", "ta", "tq"), of("ln", "la", "lq"), of("tn - ln", "ta - la", "tq - lq")
    scale = "nullif(imp, 0)" if criterion == "squared_error" else "1"
    out = []
    for k in range(depth):
        r, e, b = f"{name}r{k}", f"{name}e{k}", f"{name}b{k}"
        long = " UNION ALL ".join(f"SELECT t, node, {f} AS f, x{f} AS v, c, w, y FROM {r}" for f in range(d))
        out.append(f"{e} AS (SELECT t, node, f, v, sum(c)::DOUBLE AS c, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS a, sum(w * y * y)::DOUBLE AS q FROM ({long}) GROUP BY 1, 2, 3, 4)")
        tried = f"SELECT DISTINCT t, node, f FROM {e}"
        if draw:
            seed, most = draw
            tried = f"SELECT t, node, f FROM (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY md5('{seed}:' || t || ':' || node || ':' || f)) AS k FROM (SELECT t, node, f FROM {e} GROUP BY 1, 2, 3 HAVING count(*) > 1)) WHERE k <= {most}"
        sums = ", ".join(f"sum({c}) OVER o AS l{c}, sum({c}) OVER (PARTITION BY t, node, f) AS t{c}" for c in "cnaq")
        out.append(f"{name}w{k} AS (SELECT t, node, f, v, lag(v) OVER (PARTITION BY t, node, f ORDER BY v) AS pv, {sums} FROM {e} JOIN ({tried}) USING (t, node, f) WINDOW o AS (PARTITION BY t, node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        out.append(f"{name}g{k} AS (SELECT t, node, f, (v + pv) / 2 AS cut, {whole} AS imp, {whole} - (ln * {left} + (tn - ln) * {right}) / tn AS gain, tc, lc, ln, la, tn, ta FROM {name}w{k} WHERE pv IS NOT NULL AND lc >= {min_leaf} AND tc - lc >= {min_leaf})")
        out.append(f"{b} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY round(gain / {scale}, 11) DESC, f, cut) AS k FROM {name}g{k}) WHERE k = 1 AND gain > 1e-12 * {scale})")
        at = "CASE b.f " + " ".join(f"WHEN {f} THEN r.x{f}" for f in range(d)) + " END"
        out.append(f"{name}r{k + 1} AS (SELECT r.* REPLACE (CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + ({at} > b.cut)::INT END AS node) FROM {r} r LEFT JOIN {b} b ON r.t = b.t AND r.node = b.node)")
    return ", ".join(out)


def nodes_sql(depth: int, mean: str) -> str:
    """(tree, place, feature, threshold, n, value) of all nodes of tree_sql() without a name."""
    inner = " UNION ALL ".join(f"SELECT t, node, f, cut, tc AS c, {mean.format(n='tn', a='ta')} AS value FROM b{k}" for k in range(depth))
    return f"SELECT t::BIGINT AS tree, node::BIGINT AS place, f::BIGINT AS feature, round(cut, 6) + 0.0 AS threshold, c::BIGINT AS n, round(value, 6) + 0.0 AS value FROM ({inner} UNION ALL SELECT t, node, -1, 0, sum(c), {mean.format(n='sum(w)', a='sum(w * y)')} FROM r{depth} GROUP BY 1, 2)"


def tree_nodes(spark, trees, column: int, shift: float = 0.0) -> DataFrame:
    rows = [(t, tree.place[k], int(tree.feature[k]), float(tree.threshold[k]), tree.rows[k], float(tree.value[k, column] + shift)) for t, tree in enumerate(trees) for k in range(len(tree.feature))]
    return spark.createDataFrame(rows, "tree long, place long, feature long, threshold double, n long, value double").withColumns({"threshold": r6("threshold", "threshold"), "value": r6("value", "value")})


GRADED_ROWS = "SELECT 0 AS t, 1 AS node, 1 AS c, 1.0::DOUBLE AS w, quality::DOUBLE AS y, n_chars::DOUBLE AS x0, d.doc_id::DOUBLE AS x1, d.doc_id AS id FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
ITEM_ROWS = "SELECT 0 AS t, 1 AS node, 1 AS c, 1.0::DOUBLE AS w, (l_returnflag = 'R')::INT::DOUBLE AS y, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id FROM lineitem"
SEED_0 = int(np.random.default_rng(0).integers(2**31))


def items(spark, sf) -> DataFrame:
    """Line items by quantity, price and discount; the class says whether they came back."""
    li = table(spark, sf, "lineitem")
    return feature_columns(li, ["l_quantity", "l_extendedprice", "l_discount"]).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_id"), "features", (F.col("l_returnflag") == "R").cast("long").alias("y"))


def bags_sql(rows: str, trees: int) -> str:
    """The rows in each tree's bag, as often as the MD5 of `id:seed:tree` says."""
    u = f"('0x' || substr(md5(id || ':{SEED_0}:' || t), 1, 12))::BIGINT / 281474976710656.0"
    count = " + ".join(f"(u >= {float(c)!r}::DOUBLE)::INT" for c in POISSON)
    return f"r0 AS (SELECT * EXCLUDE (u, n) REPLACE (n::DOUBLE AS w, n AS c) FROM (SELECT *, {count} AS n FROM (SELECT *, {u} AS u FROM (SELECT r.* REPLACE (z.t AS t) FROM ({rows}) r, (SELECT unnest(range({trees})) AS t) z))) WHERE n > 0)"


@query(f"WITH r0 AS ({GRADED_ROWS}), {tree_sql(4, 2, 'entropy', min_leaf=5)}, l AS (SELECT node, sum(y) / count(*) AS p FROM r4 GROUP BY 1) SELECT id AS row_id, (p > 0.5)::BIGINT AS prediction, round(greatest(p, 1 - p), 6) AS share FROM r4 JOIN l USING (node)")
def decision_tree_predict(spark, sf):
    df = graded(spark, sf)
    m = DecisionTreeClassifier("entropy", max_depth=4, min_samples_leaf=5).fit(df)
    return m.predict(m.predict_proba(df)).select("row_id", "prediction", r6(F.array_max("proba"), "share"))


@query(f"WITH r0 AS ({ITEM_ROWS}), {tree_sql(2, 3, 'gini')} {nodes_sql(2, '({a}) / ({n})')}")
def decision_tree_levels(spark, sf):
    """Every level by prefix scan: no node is left to one task."""
    m = DecisionTreeClassifier(max_depth=2).fit(items(spark, sf), local_cells=0)
    return tree_nodes(spark, [m.tree_], 1)


@query(f"WITH r0 AS (SELECT * EXCLUDE (x1, x2) REPLACE (x1 AS y), x2 AS x1 FROM ({ITEM_ROWS})), {tree_sql(2, 2, 'squared_error')} {nodes_sql(2, '({a}) / ({n})').replace('round(value, 6)', 'round(value, 2)')}")
def regression_tree_levels(spark, sf):
    m = DecisionTreeRegressor(max_depth=2).fit(prices(spark, sf), local_cells=0)
    return tree_nodes(spark, [m.tree_], 0, m.center_).withColumn("value", r6("value", "value", 2))


@query("""WITH u AS (SELECT 0 AS f, l_quantity AS v, l_extendedprice AS y FROM lineitem UNION ALL SELECT 1, l_discount, l_extendedprice FROM lineitem),
e AS (SELECT f, v, count(*) AS n, sum(y - (SELECT avg(l_extendedprice) FROM lineitem)) AS a FROM u GROUP BY 1, 2),
w AS (SELECT f, v, lead(v) OVER o AS nx, sum(n) OVER o AS ln, sum(a) OVER o AS la, sum(n) OVER (PARTITION BY f) AS tn, sum(a) OVER (PARTITION BY f) AS ta FROM e WINDOW o AS (PARTITION BY f ORDER BY v)),
g AS (SELECT *, (v + nx) / 2 AS cut, la * la / ln + (ta - la) * (ta - la) / (tn - ln) AS gain FROM w WHERE nx IS NOT NULL)
SELECT f::BIGINT AS feature, round(cut, 6) AS threshold, ln::BIGINT AS n_left, round((SELECT avg(l_extendedprice) FROM lineitem) + la / ln, 2) AS left_mean FROM g ORDER BY gain DESC, f, cut LIMIT 1""")
def regression_tree_root(spark, sf):
    m = DecisionTreeRegressor(max_depth=1).fit(prices(spark, sf))
    t = m.tree_
    return spark.createDataFrame([(t.feature[0], float(t.threshold[0]), t.rows[1], float(t.value[1, 0] + m.center_))], "feature long, threshold double, n_left long, left_mean double").select("feature", r6("threshold", "threshold"), "n_left", r6("left_mean", "left_mean", 2))


@query(f"WITH {bags_sql(GRADED_ROWS, 10)}, {tree_sql(5, 2, 'gini', draw=(SEED_0, 1))}, "
       f"n0 AS (SELECT z.t, 1 AS node, r.* EXCLUDE (t, node) FROM ({GRADED_ROWS}) r, (SELECT unnest(range(10)) AS t) z), "
       + ", ".join(f"n{k + 1} AS (SELECT r.* REPLACE (CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + (CASE b.f WHEN 0 THEN r.x0 WHEN 1 THEN r.x1 END > b.cut)::INT END AS node) FROM n{k} r LEFT JOIN b{k} b ON r.t = b.t AND r.node = b.node)" for k in range(5))
       + ", l AS (SELECT t, node, sum(w * y) / sum(w) AS p FROM r5 GROUP BY 1, 2), p AS (SELECT id, avg(p) AS p FROM n5 JOIN l USING (t, node) GROUP BY 1) SELECT id AS row_id, (p > 0.5)::BIGINT AS prediction, round(greatest(p, 1 - p), 6) AS share FROM p")
def random_forest(spark, sf):
    df = graded(spark, sf)
    m = RandomForestClassifier(10, max_depth=5, oob_score=True, random_state=0).fit(df)
    return m.predict(m.predict_proba(df)).select("row_id", "prediction", r6(F.array_max("proba"), "share"))


@query(f"WITH {bags_sql(ITEM_ROWS, 3)}, {tree_sql(2, 3, 'gini', draw=(SEED_0, 1))} {nodes_sql(2, '({a}) / ({n})')}")
def random_forest_levels(spark, sf):
    """Three trees as one frontier, every level by prefix scan."""
    m = RandomForestClassifier(3, max_depth=2, random_state=0).fit(items(spark, sf), local_cells=0)
    return tree_nodes(spark, m.trees_, 1)


def samme_sql(rows: str, d: int, rounds: int) -> str:
    """a<k>(err, alpha) and s<k>r1 (rows with their stump's node) of each round, and p(round, id, y, lead): the running decision."""
    parts, said = [f"s0r0 AS ({rows})"], []
    for k in range(rounds):
        parts.append(tree_sql(1, d, "gini", f"s{k}"))
        parts.append(f"v{k} AS (SELECT r.*, (l.a * 2 > l.n)::INT AS p FROM s{k}r1 r JOIN (SELECT node, sum(w) AS n, sum(w * y) AS a FROM s{k}r1 GROUP BY 1) l USING (node))")
        parts.append(f"a{k} AS (SELECT err, ln((1 - err) / err) AS alpha FROM (SELECT sum(CASE WHEN p <> y THEN w ELSE 0 END) / sum(w) AS err FROM v{k}))")
        parts.append(f"s{k + 1}r0 AS (SELECT * REPLACE (w / sum(w) OVER () AS w) FROM (SELECT v.* EXCLUDE (p) REPLACE (CASE WHEN p <> y THEN w * exp(alpha) ELSE w END AS w, 1 AS node) FROM v{k} v, a{k}))")
        said.append(f"SELECT {k + 1} AS round, id, y, alpha, CASE WHEN p = 1 THEN alpha ELSE -alpha END AS vote FROM v{k}, a{k}")
    parts.append(f"p AS (SELECT round, id, y, 2 * sum(vote) OVER o / sum(alpha) OVER o AS lead FROM ({' UNION ALL '.join(said)}) WINDOW o AS (PARTITION BY id ORDER BY round))")
    return ", ".join(parts)


@query(f"WITH {samme_sql(GRADED_ROWS, 2, 3)} SELECT round::BIGINT AS round, round(avg(((lead > 0)::INT = y)::INT), 6) AS accuracy FROM p GROUP BY 1")
def adaboost_staged(spark, sf):
    df = graded(spark, sf)
    m = AdaBoostClassifier(3, max_depth=1).fit(df)
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(m.staged_score(df), 1)], "round long, accuracy double").select("round", r6("accuracy", "accuracy"))


@query(f"WITH {samme_sql(GRADED_ROWS, 2, 3)} SELECT id AS row_id, round(lead, 6) + 0.0 AS decision, (lead > 0)::BIGINT AS prediction FROM p WHERE round = 3")
def adaboost_decision(spark, sf):
    df = graded(spark, sf)
    m = AdaBoostClassifier(3, max_depth=1).fit(df)
    return m.predict(m.decision_function(df)).select("row_id", r6("decision", "decision"), "prediction")


@query(f"WITH {samme_sql(ITEM_ROWS, 3, 3)} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS round, round(err, 6) AS error, round(alpha, 6) + 0.0 AS alpha, f::BIGINT AS feature, round(cut, 6) + 0.0 AS threshold FROM a{k}, s{k}b0" for k in range(3)))
def adaboost_rounds(spark, sf):
    m = AdaBoostClassifier(3).fit(items(spark, sf), local_cells=0)
    rows = [(k, float(e), float(a), int(t.feature[0]), float(t.threshold[0])) for k, (e, a, t) in enumerate(zip(m.estimator_errors_, m.estimator_weights_, m.trees_, strict=True))]
    df = spark.createDataFrame(rows, "round long, error double, alpha double, feature long, threshold double")
    return df.select("round", r6("error", "error"), r6("alpha", "alpha"), "feature", r6("threshold", "threshold"))


def boosting_sql(rows: str, d: int, rounds: int, depth: int, rate: float) -> str:
    """z<k>(id, y1, raw): raw scores after k rounds of two-class boosting."""
    source = f"SELECT *, y AS y1 FROM ({rows})"
    parts = [f"src AS ({source})", "z0 AS (SELECT src.*, ln(p / (1 - p)) AS raw FROM src, (SELECT avg(y1) AS p FROM src))"]
    for k in range(rounds):
        parts.append(f"g{k}r0 AS (SELECT * REPLACE (y1 - 1 / (1 + exp(-raw)) AS y, 1 AS node) FROM z{k})")
        parts.append(tree_sql(depth, d, "squared_error", f"g{k}"))
        leaf = f"SELECT node, CASE WHEN sum(abs(y) * (1 - abs(y))) >= 1e-12 THEN sum(y) / sum(abs(y) * (1 - abs(y))) ELSE 0 END AS v FROM g{k}r{depth} GROUP BY 1"
        parts.append(f"z{k + 1} AS (SELECT r.* REPLACE (raw + {rate} * v AS raw) FROM g{k}r{depth} r JOIN ({leaf}) l USING (node))")
    return ", ".join(parts)


@query(f"WITH {boosting_sql(GRADED_ROWS, 2, 3, 2, 0.1)} SELECT id AS row_id, (raw > 0)::BIGINT AS prediction, round(raw, 6) + 0.0 AS decision FROM z3")
def gradient_boosting(spark, sf):
    df = graded(spark, sf)
    m = GradientBoostingClassifier(n_estimators=3, max_depth=2).fit(df)
    return m.predict(m.decision_function(df)).select("row_id", "prediction", r6("decision", "decision"))


@query(f"WITH {boosting_sql(ITEM_ROWS, 3, 2, 2, 0.3)}, s AS (SELECT 1 AS round, raw, y1 FROM z1 UNION ALL SELECT 2, raw, y1 FROM z2) SELECT round::BIGINT AS round, round(avg(greatest(raw, 0) + ln(1 + exp(-abs(raw))) - y1 * raw), 8) AS deviance, round(avg(raw), 6) + 0.0 AS mean_decision, round(avg(((raw > 0)::INT = y1)::INT), 6) AS accuracy FROM s GROUP BY 1")
def gradient_boosting_staged(spark, sf):
    """Two rounds whose trees grow by prefix scan throughout."""
    df = items(spark, sf)
    m = GradientBoostingClassifier(0.3, n_estimators=2, max_depth=2).fit(df, local_cells=0)
    rounds = range(len(m.trees_))
    right = [((F.get("stages", F.lit(k)) > 0).cast("long") == F.col("y")).cast("double") for k in rounds]
    r = m.staged(df).agg(*[F.avg(F.get("stages", F.lit(k))).alias(f"m{k}") for k in rounds], *[F.avg(c).alias(f"a{k}") for k, c in enumerate(right)])  # one row
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).cast("long").alias("round"), F.lit(m.train_score_[k]).alias("d"), F.col(f"m{k}").alias("m"), F.col(f"a{k}").alias("a")) for k in rounds]))
    return r.select(each.alias("z")).select("z.round", r6("z.d", "deviance", 8), r6("z.m", "mean_decision"), r6("z.a", "accuracy"))


# --- clustering and decomposition -------------------------------------------------------------------------------------

STARTS = [[0.0, 4.0], [4.0, 12.0], [8.0, 20.0]]


def lloyd_sql(steps: int, starts: list[str] | None = None) -> str:
    """Steps from STARTS, or from what the CTEs of starts call c0."""
    start = " UNION ALL ".join(f"SELECT {k} AS k, {a}::DOUBLE AS a, {b}::DOUBLE AS b" for k, (a, b) in enumerate(STARTS))
    parts = list(starts or [f"c0 AS ({start})"])
    for s in range(steps + 1):
        parts.append(f"d{s} AS (SELECT id, x1, x2, arg_min(k, d * 1000000 + k * 1e-6) AS k, min(d) AS d FROM (SELECT id, x1, x2, k, (x1 - a) * (x1 - a) + (x2 - b) * (x2 - b) AS d FROM t, c{s}) GROUP BY 1, 2, 3)")
        parts.append(f"c{s + 1} AS (SELECT k, avg(x1) AS a, avg(x2) AS b FROM d{s} GROUP BY 1)")
    return f"WITH t AS ({PLACES}), " + ", ".join(parts) + f" SELECT c.k::BIGINT AS cluster, round(c.a, 6) + 0.0 AS x1, round(c.b, 6) + 0.0 AS x2, (SELECT count(*) FROM d{steps} d WHERE d.k = c.k) AS n, (SELECT round(sum(d), 3) FROM d{steps}) AS inertia FROM c{steps} c"


@query(lloyd_sql(3))
def kmeans(spark, sf):
    df = places(spark, sf)
    m = KMeans(3, init=STARTS, max_iter=3, tol=0.0).fit(df)
    n = m.predict(df).groupBy(F.col("prediction").cast("long").alias("cluster")).agg(F.count("*").alias("n"))
    c = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(m.cluster_centers_)], "cluster long, x1 double, x2 double")
    return c.join(n, "cluster").select("cluster", r6("x1", "x1"), r6("x2", "x2"), "n", r6(F.lit(m.inertia_), "inertia", 3))


def drawn_sql(k: int) -> list[str]:
    """CTEs up to c0(k, a, b): k rows drawn one after the other, each with the squared distance to those drawn as its weight."""
    parts = []
    for j in range(k):
        u = f"((('0x' || substr(md5(id || ':{SEED_0}:{j}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
        near = "least(" + ", ".join(f"(SELECT (x1 - a) * (x1 - a) + (x2 - b) * (x2 - b) FROM q{i})" for i in range(j)) + ")" if j else "1.0"
        parts.append(f"q{j} AS (SELECT {j} AS k, x1 AS a, x2 AS b FROM (SELECT x1, x2, -ln({u}) / w AS clock FROM (SELECT *, {near} AS w FROM t) WHERE w > 0) ORDER BY clock LIMIT 1)")
    return [*parts, "c0 AS (" + " UNION ALL ".join(f"SELECT * FROM q{j}" for j in range(k)) + ")"]


@query(lloyd_sql(3, drawn_sql(4)))
def kmeans_drawn_starts(spark, sf):
    """Three steps from k-means++ starts."""
    df = places(spark, sf)
    m = KMeans(4, n_init=1, max_iter=3, tol=0.0, random_state=0).fit(df)
    n = m.predict(df).groupBy(F.col("prediction").cast("long").alias("cluster")).agg(F.count("*").alias("n"))
    c = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(m.cluster_centers_)], "cluster long, x1 double, x2 double")
    return c.join(n, "cluster").select("cluster", r6("x1", "x1"), r6("x2", "x2"), "n", r6(F.lit(m.inertia_), "inertia", 3))


@query()
def kmeans_plus_plus(spark, sf):
    df = places(spark, sf)
    return KMeans(4, n_init=2, max_iter=10, random_state=0).fit_predict(df).select("row_id", "prediction")


@query("""WITH RECURSIVE t AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x1, s_nationkey::DOUBLE AS x2 FROM supplier),
n AS (SELECT a.id AS a, b.id AS b FROM t a, t b WHERE sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) <= 1.5),
c AS (SELECT a FROM n GROUP BY 1 HAVING count(*) >= 4), cc AS (SELECT n.a, n.b FROM n WHERE n.a IN (SELECT a FROM c) AND n.b IN (SELECT a FROM c)),
r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, cc.b FROM r JOIN cc ON cc.a = r.b),
g AS (SELECT a, min(b) AS m FROM r GROUP BY 1), f AS (SELECT n.a, min(g.m) AS m FROM n JOIN g ON g.a = n.b GROUP BY 1),
k AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS label FROM (SELECT DISTINCT m FROM g))
SELECT t.id AS row_id, coalesce(k.label, -1)::INT AS label FROM t LEFT JOIN f ON f.a = t.id LEFT JOIN k ON k.m = f.m""")
def dbscan(spark, sf):
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("features"))
    return DBSCAN(1.5, 4).fit_predict(df)


@query(f"""WITH t AS ({PLACES}), p AS (SELECT * FROM (VALUES (0, 0.5, 2.0, 6.0, 9.0, 16.0), (1, 0.5, 6.0, 18.0, 9.0, 16.0)) p(k, w, m1, m2, v1, v2)),
j AS (SELECT id, x1, x2, k, w * exp(-0.5 * ((x1 - m1) * (x1 - m1) / v1 + (x2 - m2) * (x2 - m2) / v2)) / sqrt(v1 * v2) AS d FROM t, p),
r AS (SELECT *, d / sum(d) OVER (PARTITION BY id) AS r FROM j), m AS (SELECT k, sum(r) AS nk, sum(r * x1) / sum(r) AS m1, sum(r * x2) / sum(r) AS m2 FROM r GROUP BY 1)
SELECT m.k::BIGINT AS component, round(any_value(nk) / (SELECT count(*) FROM t), 6) AS weight, round(any_value(m1), 6) AS mean1, round(any_value(m2), 6) AS mean2,
  round(sum(r * (x1 - m1) * (x1 - m1)) / any_value(nk) + 1e-6, 5) AS var1, round(sum(r * (x2 - m2) * (x2 - m2)) / any_value(nk) + 1e-6, 5) AS var2 FROM r JOIN m ON m.k = r.k GROUP BY 1""")
def gaussian_mixture_step(spark, sf):
    start = ([0.5, 0.5], [[2.0, 6.0], [6.0, 18.0]], [[9.0, 16.0], [9.0, 16.0]])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = GaussianMixture(2, covariance_type="diag", max_iter=1, init_params=start).fit(places(spark, sf))
    rows = [(k, float(m.weights_[k]), *map(float, m.means_[k]), *map(float, m.covariances_[k])) for k in range(2)]
    df = spark.createDataFrame(rows, "component long, weight double, mean1 double, mean2 double, var1 double, var2 double")
    return df.select("component", r6("weight", "weight"), r6("mean1", "mean1"), r6("mean2", "mean2"), r6("var1", "var1", 5), r6("var2", "var2", 5))


def mixture_sql(kind: str, steps: int) -> str:
    """e<kind><k>: two components in the plane after k steps of expectation maximisation, as (k, w, m1, m2, a, b, c) with covariance [[a, b], [b, c]]."""
    name = lambda p, k: f"{kind}_{p}{k}"
    parts = [f"{name('e', 0)} AS (SELECT * FROM (VALUES (0, 0.5, 2.0, 6.0, 9.0, 0.0, 9.0), (1, 0.5, 6.0, 18.0, 9.0, 0.0, 9.0)) e(k, w, m1, m2, a, b, c))"]
    for s in range(steps + 1):
        j, r, m, c, e = (name(p, s) for p in "jrmce")
        parts.append(f"{j} AS (SELECT id, x1, x2, k, ln(w) - 0.5 * (c * (x1 - m1) * (x1 - m1) - 2 * b * (x1 - m1) * (x2 - m2) + a * (x2 - m2) * (x2 - m2)) / (a * c - b * b) - 0.5 * ln(a * c - b * b) - ln(2 * pi()) AS l FROM t, {e})")
        parts.append(f"{r} AS (SELECT *, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY id) AS r, top + ln(sum(exp(l - top)) OVER (PARTITION BY id)) AS z FROM (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM {j}))")
        if s == steps:
            break
        parts.append(f"{m} AS (SELECT k, sum(r) AS n, sum(r * x1) / sum(r) AS m1, sum(r * x2) / sum(r) AS m2 FROM {r} GROUP BY 1)")
        parts.append(f"{c} AS (SELECT k, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, sum(r * (x1 - m1) * (x1 - m1)) AS s11, sum(r * (x1 - m1) * (x2 - m2)) AS s12, sum(r * (x2 - m2) * (x2 - m2)) AS s22 FROM {r} JOIN {m} USING (k) GROUP BY 1)")
        a, b, d = {"full": ("s11 / n + 1e-6", "s12 / n", "s22 / n + 1e-6"), "spherical": ("(s11 + s22) / n / 2 + 1e-6", "0.0", "(s11 + s22) / n / 2 + 1e-6"), "tied": ("sum(s11) OVER () / sum(n) OVER () + 1e-6", "sum(s12) OVER () / sum(n) OVER ()", "sum(s22) OVER () / sum(n) OVER () + 1e-6")}[kind]
        parts.append(f"{name('e', s + 1)} AS (SELECT k, n / sum(n) OVER () AS w, m1, m2, {a} AS a, {b} AS b, {d} AS c FROM {c})")
    return ", ".join(parts)


def mixture_row(kind: str, steps: int) -> str:
    size = {"full": 11, "tied": 8, "spherical": 7}[kind]
    scores = f"(SELECT sum(z) AS s, count(*) AS n FROM (SELECT id, any_value(z) AS z FROM {kind}_r{steps} GROUP BY 1))"
    picked = f"(SELECT k, count(*) AS n FROM (SELECT id, arg_max(k, r - k * 1e-15) AS k FROM {kind}_r{steps} GROUP BY 1) GROUP BY 1)"
    return f"SELECT '{kind}' AS kind, e.k::BIGINT AS component, round(w, 5) AS weight, round(m1, 5) AS mean1, round(m2, 5) AS mean2, round(a, 4) AS var1, round(b, 4) + 0.0 AS cov, round(c, 4) AS var2, coalesce(q.n, 0) AS picked, round(-2 * s.s + {size} * ln(s.n), 3) AS bic, round(-2 * s.s + 2 * {size}, 3) AS aic FROM {kind}_e{steps} e LEFT JOIN {picked} q ON q.k = e.k, {scores} s"


@query(f"WITH t AS ({PLACES}), {mixture_sql('full', 3)}, {mixture_sql('tied', 3)}, {mixture_sql('spherical', 3)} " + " UNION ALL ".join(mixture_row(k, 3) for k in ("full", "tied", "spherical")))
def gaussian_mixture_kinds(spark, sf):
    """Three steps from given starts for each kind of covariance, the labels then given, and both information criteria."""
    df = places(spark, sf)
    starts = {"full": [np.eye(2) * 9.0] * 2, "tied": np.eye(2) * 9.0, "spherical": [9.0, 9.0]}
    rows, picked = [], None
    for kind, cov in starts.items():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            m = GaussianMixture(2, kind, tol=0.0, max_iter=3, init_params=([0.5, 0.5], [[2.0, 6.0], [6.0, 18.0]], cov)).fit(df)
        whole = {"full": lambda k, m=m: m.covariances_[k], "tied": lambda k, m=m: m.covariances_, "spherical": lambda k, m=m: np.eye(2) * m.covariances_[k]}[kind]
        rows += [(kind, k, float(m.weights_[k]), *map(float, m.means_[k]), float(whole(k)[0, 0]), float(whole(k)[0, 1]), float(whole(k)[1, 1]), m.bic(df), m.aic(df)) for k in range(2)]
        said = m.predict(df).groupBy(F.lit(kind).alias("kind"), F.col("prediction").cast("long").alias("component")).agg(F.count("*").alias("picked"))
        picked = said if picked is None else picked.unionByName(said)
    out = spark.createDataFrame(rows, "kind string, component long, weight double, mean1 double, mean2 double, var1 double, cov double, var2 double, bic double, aic double")
    out = out.join(picked, ["kind", "component"], "left")
    digits = {"weight": 5, "mean1": 5, "mean2": 5, "var1": 4, "cov": 4, "var2": 4, "bic": 3, "aic": 3}
    return out.select("kind", "component", *[r6(c, c, n) for c, n in digits.items()], F.coalesce("picked", F.lit(0).cast("long")).alias("picked"))


@query()
def gaussian_mixture_full(spark, sf):
    df = places(spark, sf)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return GaussianMixture(2, max_iter=5, random_state=0).fit(df).predict(df).select("row_id", "prediction")


@query(f"""WITH s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, covar_samp(x1, x1) AS a, covar_samp(x2, x2) AS d, covar_samp(x1, x2) AS b FROM ({PLACES})),
e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS l2 FROM s)
SELECT round(l1, 5) AS variance1, round(l2, 5) AS variance2, round(l1 / (l1 + l2), 6) AS ratio1, round(abs(l1 - d) / sqrt((l1 - d) * (l1 - d) + b * b), 5) AS size_x1 FROM e""")
def pca_fit(spark, sf):
    m = PCA().fit(places(spark, sf))
    return one_row(spark, variance1=m.explained_variance_[0], variance2=m.explained_variance_[1], ratio1=m.explained_variance_ratio_[0], size_x1=abs(m.components_[0, 0])).select(r6("variance1", "variance1", 5), r6("variance2", "variance2", 5), r6("ratio1", "ratio1"), r6("size_x1", "size_x1", 5))


@query(f"""WITH t AS ({PLACES}), s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, covar_samp(x1, x1) AS a, covar_samp(x2, x2) AS d, covar_samp(x1, x2) AS b FROM t),
e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1 FROM s), n AS (SELECT *, (l1 - d) / sqrt((l1 - d) * (l1 - d) + b * b) AS u0, b / sqrt((l1 - d) * (l1 - d) + b * b) AS v0 FROM e),
f AS (SELECT *, CASE WHEN (CASE WHEN abs(u0) >= abs(v0) THEN u0 ELSE v0 END) < 0 THEN -1 ELSE 1 END AS f1, CASE WHEN (CASE WHEN abs(v0) >= abs(u0) THEN -v0 ELSE u0 END) < 0 THEN -1 ELSE 1 END AS f2 FROM n)
SELECT id AS row_id, round(f1 * (u0 * (x1 - m1) + v0 * (x2 - m2)), 5) + 0.0 AS c1, round(f2 * (-v0 * (x1 - m1) + u0 * (x2 - m2)), 5) + 0.0 AS c2, round(x1, 5) + 0.0 AS back1, round(x2, 5) + 0.0 AS back2 FROM t, f""")
def pca_scores(spark, sf):
    """Both components of each row, signs fixed by the largest loading, and the row got back from them."""
    df = places(spark, sf)
    m = PCA(2).fit(df)
    out = m.inverse_transform(m.transform(df), into="back")
    return out.select("row_id", *[r6(F.get("components", F.lit(k)), f"c{k + 1}", 5) for k in range(2)], *[r6(F.get("back", F.lit(k)), f"back{k + 1}", 5) for k in range(2)])


@query()
def pca_transform(spark, sf):
    df = vectors(spark, sf)
    return PCA(3).fit_transform(df).select("row_id", *[r6(F.get("components", F.lit(k)), f"c{k}", 5) for k in range(3)])


# --- optimizers: five steps on 0.5 * a * x^2 for every part's price ---------------------------------------------------

PARTS = "SELECT p_partkey, p_retailprice / 1000 AS x, p_size / 10.0 AS a FROM part"


def optimizer_sql(state: str, assign: str, move: str, steps: int = 4) -> str:
    sql = f"SELECT p_partkey, a, x, {state}, 1 AS t FROM ({PARTS})"
    for _ in range(steps):
        sql = f"SELECT p_partkey, a, x - ({move}) AS x, m, s, t + 1 AS t FROM (SELECT p_partkey, a, x, {assign}, t, g FROM (SELECT *, a * x AS g FROM ({sql})))"
    return f"SELECT p_partkey, round(x, 6) + 0.0 AS x FROM ({sql})"


def optimised(make) -> Query:
    def run(spark, sf):
        df = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_retailprice") / 1000, F.col("p_size") / 10.0).alias("features"))

        def kernel(x):
            o, p = make(), x[:, 0].copy()
            for _ in range(4):
                o.step([p], [x[:, 1] * p])
            return p

        return apply_kernel(df, "features", "x", kernel, T.DoubleType()).select("p_partkey", r6("x", "x"))

    return run


ZERO = "0.0::DOUBLE AS m, 0.0::DOUBLE AS s"
for _name, _make, _assign, _move in (
    ("optimizer_sgd", lambda: O.SGD(0.05), "m, s", "0.05 * g"),
    ("optimizer_momentum", lambda: O.Momentum(0.05, 0.9), "0.9 * m - 0.05 * g AS m, s", "-m"),
    ("optimizer_nesterov", lambda: O.Nesterov(0.05, 0.9), "0.9 * m - 0.05 * g AS m, m AS s", "0.9 * s - 1.9 * m"),
    ("optimizer_rmsprop", lambda: O.RMSprop(0.01, 0.9), "m, 0.9 * s + 0.1 * g * g AS s", "0.01 * g / (sqrt(s) + 1e-8)"),
    ("optimizer_adam", lambda: O.Adam(0.01), "0.9 * m + 0.1 * g AS m, 0.999 * s + 0.001 * g * g AS s", "0.01 * (m / (1 - pow(0.9, t))) / (sqrt(s / (1 - pow(0.999, t))) + 1e-8)"),
):
    _QUERIES[_name], _SQL[_name] = optimised(_make), optimizer_sql(ZERO, _assign, _move)

# --- tokenizers -------------------------------------------------------------------------------------------------------


@query("SELECT c AS token, (row_number() OVER (ORDER BY c) - 1)::INT AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def char_vocabulary(spark, sf):
    return characters(table(spark, sf, "documents"))


@query("""WITH v AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> ''),
t AS (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM benchmark)
SELECT item_id, count(*) AS n, sum(id * k)::BIGINT AS weighted, any_value(text) AS decoded FROM t JOIN v USING (c) JOIN benchmark USING (item_id) GROUP BY 1""")
def char_encode_decode(spark, sf):
    df = table(spark, sf, "benchmark")
    tok = CharTokenizer().fit(df)
    out = tok.decode(tok.encode(df))
    weighted = F.aggregate(F.transform("ids", lambda x, k: x.cast("long") * (k + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("item_id", F.size("ids").cast("long").alias("n"), weighted.alias("weighted"), "decoded")


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM documents),
p AS (SELECT c AS "left", lead(c) OVER (PARTITION BY doc_id ORDER BY k) AS "right" FROM t) SELECT "left", "right", count(*) AS n FROM p WHERE "right" IS NOT NULL GROUP BY 1, 2""")
def bpe_pair_counts(spark, sf):
    return adjacent_pairs(table(spark, sf, "documents"))


def bpe_sql(merges: int, table_: str = "documents", key: str = "doc_id") -> str:
    """CTEs m<k>(a, b, n), the k-th merge, and t<k>(id, pos, tok), the texts before it, by replacing pairs in a table's characters."""
    parts = [f"t0 AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS pos, c AS tok FROM (SELECT {key} AS id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM {table_}) WHERE c <> '')"]
    for k in range(merges):
        parts.append(f"p{k} AS (SELECT id, pos, tok, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS nx FROM t{k})")
        parts.append(f"m{k} AS (SELECT tok AS a, nx AS b, count(*) AS n FROM p{k} WHERE nx IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 1)")
        parts.append(f"h{k} AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM p{k}, m{k} WHERE tok = a AND nx = b)")
        parts.append(f"g{k} AS (SELECT id, pos FROM (SELECT id, pos, row_number() OVER (PARTITION BY id, run ORDER BY pos) AS r FROM h{k}), m{k} WHERE a <> b OR r % 2 = 1)")
        parts.append(f"t{k + 1} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos, tok FROM (SELECT p.id, p.pos, CASE WHEN g.pos IS NULL THEN p.tok ELSE m.a || m.b END AS tok FROM p{k} p CROSS JOIN m{k} m LEFT JOIN g{k} g ON g.id = p.id AND g.pos = p.pos LEFT JOIN g{k} l ON l.id = p.id AND l.pos = p.pos - 1 WHERE l.pos IS NULL))")
    return "WITH " + ", ".join(parts)


@query(bpe_sql(6) + " " + " UNION ALL ".join(f"SELECT {k + 1}::BIGINT AS rank, a AS \"left\", b AS \"right\", n FROM m{k}" for k in range(6)))
def bpe_training(spark, sf):
    """The first six merges over all documents."""
    tok = BPETokenizer(6).fit(table(spark, sf, "documents"))
    rows = [(k, a, b, n) for k, ((a, b), n) in enumerate(zip(tok.merges_, tok.merge_counts_, strict=True), 1)]
    return spark.createDataFrame(rows, "rank long, left string, right string, n long")


@query(bpe_sql(8, "benchmark", "item_id") + " SELECT item_id, coalesce(n, 0) AS n, true AS same FROM benchmark LEFT JOIN (SELECT id, count(*) AS n FROM t8 GROUP BY 1) ON id = item_id")
def bpe_merges(spark, sf):
    df = table(spark, sf, "benchmark")
    tok = BPETokenizer(8).fit(df)
    out = tok.decode(tok.encode(df))
    return out.select("item_id", F.size("ids").cast("long").alias("n"), (F.col("decoded") == F.col("text")).alias("same"))


# --- tensors ----------------------------------------------------------------------------------------------------------


@query(f"WITH l AS ({LONG}) SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM l a JOIN l b ON a.n = b.n GROUP BY 1, 2")
def tensor_matmul(spark, sf):
    x = long_vectors(spark, sf)
    return rel.contract(x, rel.transpose(x, {"i": "j"}), ["n"]).select("i", "j", r6("v", "v", 5))


@query(f"WITH l AS ({LONG}), m AS (SELECT i, avg(v) AS m FROM l GROUP BY 1) SELECT n, i::INT AS i, round((v - m) * 2 + exp(v) / (1 + v * v), 6) + 0.0 AS v FROM l JOIN m USING (i)")
def tensor_broadcast(spark, sf):
    x = long_vectors(spark, sf)
    centred = rel.apply(rel.sub(x, rel.reduce(x, ["n"], F.avg)), lambda v: v * 2)
    return rel.add(centred, rel.div(rel.apply(x, F.exp), rel.apply(rel.mul(x, x), lambda v: v + 1))).select("n", "i", r6("v", "v"))


@query(f"WITH l AS ({LONG}) SELECT n, i::INT AS i, round(exp(v) / sum(exp(v)) OVER (PARTITION BY n), 6) AS v, round(v - ln(sum(exp(v)) OVER (PARTITION BY n)), 6) AS log_v FROM l")
def tensor_softmax(spark, sf):
    x = long_vectors(spark, sf)
    return rel.softmax(x, ["i"]).join(rel.log_softmax(x, ["i"]).withColumnRenamed("v", "log_v"), ["n", "i"]).select("n", "i", r6("v", "v"), r6("log_v", "log_v"))


@query(f"WITH l AS ({LONG}) SELECT n, i::INT AS i, round((v - avg(v) OVER (PARTITION BY n)) / sqrt(var_pop(v) OVER (PARTITION BY n) + 1e-5), 6) + 0.0 AS layer, round((v - avg(v) OVER (PARTITION BY i)) / sqrt(var_pop(v) OVER (PARTITION BY i) + 1e-5), 6) + 0.0 AS batch FROM l")
def tensor_norms(spark, sf):
    x = long_vectors(spark, sf)
    return rel.normalise(x, ["i"]).withColumnRenamed("v", "a").join(rel.normalise(x, ["n"]), ["n", "i"]).select("n", "i", r6("a", "layer"), r6("v", "batch"))


@query(f"WITH l AS ({LONG}) SELECT n, i::INT AS i, greatest(v, 0) AS relu, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(tanh(v), 6) + 0.0 AS tanh, round(0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v * v * v))), 6) + 0.0 AS gelu FROM l")
def activations(spark, sf):
    x, v = long_vectors(spark, sf), F.col("v")
    return x.select("n", "i", expr.relu(v).alias("relu"), r6(expr.sigmoid(v), "sigmoid"), r6(F.tanh(v), "tanh"), r6(expr.gelu(v), "gelu"))


@query(f"""WITH l AS ({LONG}), z AS (SELECT n, any_value(label) AS y, ln(sum(exp(v)) FILTER (i < 10)) AS lse, max(v) FILTER (i = label) AS own, max(v) FILTER (i = 0) AS z0 FROM l GROUP BY 1)
SELECT round(avg(lse - own), 6) AS cross_entropy, round(avg(greatest(z0, 0) + ln(1 + exp(-abs(z0))) - (y % 2) * z0), 6) AS bce, round(avg((z0 - y) * (z0 - y)), 6) AS mse FROM z""")
def losses(spark, sf):
    df = vectors(spark, sf).select("y", F.slice("features", 1, 10).alias("z")).withColumn("z0", F.get("z", F.lit(0)))
    ce = F.avg(expr.logsumexp(F.col("z")) - F.get("z", F.col("y").cast("int")))
    return df.agg(r6(ce, "cross_entropy"), r6(F.avg(expr.softplus(F.col("z0")) - (F.col("y") % 2) * F.col("z0")), "bce"), r6(M.mean_squared_error("y", "z0"), "mse"))


ATTENTION = f"""WITH l AS ({LONG}), s AS (SELECT a.label AS b, a.n AS i, c.n AS j, sum(a.v * c.v) / sqrt(64.0) + CASE WHEN c.n <= a.n THEN 0 ELSE -1e9 END AS s FROM l a JOIN l c ON a.label = c.label AND a.i = c.i GROUP BY 1, 2, 3),
w AS (SELECT b, i, j, exp(s - max(s) OVER p) AS e FROM s WINDOW p AS (PARTITION BY b, i)), x AS (SELECT b, i, j, e / sum(e) OVER (PARTITION BY b, i) AS w FROM w)"""


@query(ATTENTION + " SELECT x.b::INT AS b, x.i AS i, l.i::INT AS e, round(sum(w * v), 6) + 0.0 AS v FROM x JOIN l ON l.n = x.j GROUP BY 1, 2, 3")
def causal_attention(spark, sf):
    """Tiles of queries walk tiles of keys; no weight of a pair is ever a row."""
    x = table(spark, sf, "embeddings").select(F.col("label").alias("b"), F.col("vec_id").alias("i"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    out = tiles.attention(x, x, x, causal=True)
    return out.select("b", "i", F.posexplode("out").alias("e", "v")).select("b", "i", "e", r6("v", "v"))


@query(f"WITH l AS ({LONG}) SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM l a JOIN l b ON a.n = b.n GROUP BY 1, 2")
def tiled_matmul(spark, sf):
    """X'X of the embeddings over tiles."""
    x = tiles.tiles(long_vectors(spark, sf).select(F.col("n").alias("i"), F.col("i").alias("j"), "v"))
    out = tiles.entries(tiles.matmul(x, x, left=True))
    return out.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6("v", "v", 5))


def images(spark, sf):
    return long_vectors(spark, sf).select("n", F.lit(0).alias("c"), F.expr("i div 8").alias("h"), (F.col("i") % 8).alias("w"), "v")


IMAGES = f"SELECT n, i // 8 AS h, i % 8 AS w, v FROM ({LONG})"


@query(f"SELECT n, 0 AS o, (h - kh + 1)::INT AS oh, (w - kw + 1)::INT AS ow, round(sum(v * (kh * 3 + kw - 4)), 6) + 0.0 AS v FROM ({IMAGES}), range(3) a(kh), range(3) b(kw) WHERE h - kh + 1 BETWEEN 0 AND 7 AND w - kw + 1 BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4")
def conv2d(spark, sf):
    kernel = spark.range(9).select(F.lit(0).alias("o"), F.lit(0).alias("c"), F.expr("int(id div 3)").alias("kh"), (F.col("id") % 3).cast("int").alias("kw"), (F.col("id") - 4).cast("double").alias("v"))
    return rel.conv2d(images(spark, sf), kernel, (3, 3), (8, 8), padding=1).select("n", "o", F.col("oh").cast("int").alias("oh"), F.col("ow").cast("int").alias("ow"), r6("v", "v"))


@query(f"SELECT n, (h // 2)::INT AS oh, (w // 2)::INT AS ow, max(v) AS v, arg_max(h, v)::INT AS h, arg_max(w, v)::INT AS w FROM ({IMAGES}) GROUP BY 1, 2, 3")
def max_pool2d(spark, sf):
    got = rel.max_pool2d(images(spark, sf), (2, 2), (8, 8))
    return got.select("n", F.col("oh").cast("int").alias("oh"), F.col("ow").cast("int").alias("ow"), "v", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"))


@query("SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1")
def embedding_scatter_add(spark, sf):
    o = table(spark, sf, "orders")
    ids = o.select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("k"))
    grad = rel.scatter_add(o.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), ids, ["i"], "k")
    return grad.join(ids.groupBy("k").agg(F.count("*").alias("n")), "k").select("k", "n", r6("v", "v", 2))


@query("SELECT conv_id, coalesce(turn, 0) AS pos, k::INT AS k, round(CASE WHEN k % 2 = 0 THEN sin(coalesce(turn, 0) * pow(10000, -2 * (k // 2) / 16)) ELSE cos(coalesce(turn, 0) * pow(10000, -2 * (k // 2) / 16)) END, 6) + 0.0 AS v FROM conversations, range(16) b(k)")
def positional_encoding(spark, sf):
    """The position of each turn in its conversation."""
    turns = table(spark, sf, "conversations").select("conv_id", F.coalesce("turn", F.lit(0).cast("long")).alias("pos"))
    longest = turns.agg(F.max("pos").alias("m")).first()["m"]
    codes = rel.positional_table(spark, (longest or 0) + 1, 16)
    return turns.join(codes, "pos").select("conv_id", "pos", "k", r6("v", "v"))


@query("SELECT s_suppkey, round(1 / (1 + exp(-s_acctbal / 5000)), 6) AS p, round(sqrt(pow(s_acctbal - 1, 2) + pow(s_nationkey - 2, 2)), 4) AS d FROM supplier")
def sql_functions(spark, sf):
    expr.register_sql_functions(spark)
    table(spark, sf, "supplier").createOrReplaceTempView("quillon_supplier")
    return spark.sql("SELECT s_suppkey, round(sigmoid(s_acctbal / 5000), 6) AS p, round(euclidean_distance(array(s_acctbal, double(s_nationkey)), array(1D, 2D)), 4) AS d FROM quillon_supplier")


# --- training and generators ------------------------------------------------------------------------------------------


@query()
def data_parallel_training(spark, sf):
    df = returned(spark, sf).select("features", F.array(F.col("y").cast("double")).alias("target"))
    losses = Trainer([Linear(2, 4, "xavier", 0), Tanh(), Linear(4, 1, "xavier", 1)], MSELoss(), O.Adam(0.05)).fit_distributed(df, 5)
    return spark.createDataFrame(list(enumerate(map(float, losses))), "step long, loss double")


@query(f"""WITH u AS (SELECT p_partkey AS k, p_size % 4 AS y, {', '.join(f"(('0x' || substr(md5(p_partkey || ':5:{n}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u{n}" for n in range(4))} FROM part),
z AS (SELECT y, 3 * y + 0.5 * sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) AS a, -3 * y + 0.5 * sqrt(-2 * ln(u2)) * cos(2 * pi() * u3) AS b FROM u)
SELECT y::BIGINT AS y, count(*) AS n, round(avg(a), 6) + 0.0 AS mean_a, round(avg(b), 6) + 0.0 AS mean_b, round(var_pop(a), 6) AS var_a, round(covar_pop(a, b), 6) + 0.0 AS cov FROM z GROUP BY 1""")
def generated_blobs(spark, sf):
    """A row of a blob for each part, around the centre of its size's remainder."""
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).cast("long").alias("y"))
    rows = generators.blobs_for(parts, "p_partkey", "y", [[3.0 * k, -3.0 * k] for k in range(4)], 0.5, 5)
    a, b = (F.get("features", F.lit(k)) for k in range(2))
    return rows.groupBy("y").agg(F.count("*").alias("n"), r6(F.avg(a), "mean_a"), r6(F.avg(b), "mean_b"), r6(F.var_pop(a), "var_a"), r6(F.covar_pop(a, b), "cov"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM events GROUP BY 1")
def keyed_stream_statistics(spark, sf):
    """The events as a stream, their running statistics by type in the state store, and the last ones of each type."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    keyed.run_available(keyed.running_statistics(events, "event_type", "value"), f"{folder}/out", f"{folder}/checkpoint")
    return keyed.latest(spark, f"{folder}/out").select(F.col("key").alias("event_type"), "n", r6("mean", "mean"), r6("variance", "variance"))


# --- networks: modules of the library inside tasks --------------------------------------------------------------------


def fixed_weights(rows: int, columns: int) -> np.ndarray:
    """Weights that SQL can state, too: entry (i, j) is ((i * columns + j) * 7 % 11 - 5) / 10."""
    return (np.arange(rows * columns) * 7 % 11 - 5).reshape(rows, columns) / 10


def fixed_sql(i: str, j: str, columns: int) -> str:
    return f"(((({i}) * {columns} + ({j})) * 7 % 11 - 5) / 10.0)"


FIRST = "embedding[{}]::DOUBLE"


def rnn_sql(steps: int, features: int) -> str:
    inner = "SELECT vec_id, embedding, 0.0::DOUBLE AS h0_0, 0.0::DOUBLE AS h1_0 FROM embeddings"
    for t in range(1, steps + 1):
        pre = [" + ".join([*(f"{FIRST.format((t - 1) * features + i + 1)} * {fixed_sql(i, j, 2)}" for i in range(features)), *(f"h{i}_{t - 1} * {fixed_sql(i, j, 2)}" for i in range(2)), f"{j} / 10.0"]) for j in range(2)]
        inner = f"SELECT *, tanh({pre[0]}) AS h0_{t}, tanh({pre[1]}) AS h1_{t} FROM ({inner})"
    return f"SELECT vec_id, round(h0_{steps}, 6) + 0.0 AS h0, round(h1_{steps}, 6) + 0.0 AS h1 FROM ({inner})"


@query(rnn_sql(4, 3))
def rnn_forward(spark, sf):
    """The last hidden state of a recurrent layer over the first twelve components, as four steps of three."""
    layer = RNN(3, 2, weight_init="zeros")
    layer.W_ih, layer.W_hh, layer.b = fixed_weights(3, 2), fixed_weights(2, 2), np.array([0.0, 0.1])
    out = apply_kernel(vectors(spark, sf), "features", "h", lambda x: layer.forward(x[:, :12].reshape(-1, 4, 3))[1])
    return out.select(F.col("row_id").alias("vec_id"), r6(F.get("h", F.lit(0)), "h0"), r6(F.get("h", F.lit(1)), "h1"))


def lstm_sql(steps: int) -> str:
    inner = "SELECT vec_id, embedding, 0.0::DOUBLE AS h_0, 0.0::DOUBLE AS c_0 FROM embeddings"
    for t in range(1, steps + 1):
        z = [f"{FIRST.format(2 * t - 1)} * {fixed_sql(0, j, 4)} + {FIRST.format(2 * t)} * {fixed_sql(1, j, 4)} + h_{t - 1} * {fixed_sql(0, j, 4)}" for j in range(4)]
        inner = f"SELECT *, {', '.join(f'{x} AS z{j}_{t}' for j, x in enumerate(z))} FROM ({inner})"
        inner = f"SELECT *, c_{t - 1} / (1 + exp(-z1_{t})) + tanh(z2_{t}) / (1 + exp(-z0_{t})) AS c_{t} FROM ({inner})"
        inner = f"SELECT *, tanh(c_{t}) / (1 + exp(-z3_{t})) AS h_{t} FROM ({inner})"
    return f"SELECT vec_id, round(h_{steps}, 6) + 0.0 AS h, round(c_{steps}, 6) + 0.0 AS c FROM ({inner})"


@query(lstm_sql(3))
def lstm_forward(spark, sf):
    """Hidden and cell state of one unit after three steps of two components."""
    layer = LSTM(2, 1, bias=False, weight_init="zeros")
    layer.W_ih, layer.W_hh = fixed_weights(2, 4), fixed_weights(1, 4)
    out = apply_kernel(vectors(spark, sf), "features", "s", lambda x: np.concatenate(layer.forward(x[:, :6].reshape(-1, 3, 2))[1], 1))
    return out.select(F.col("row_id").alias("vec_id"), r6(F.get("s", F.lit(0)), "h"), r6(F.get("s", F.lit(1)), "c"))


SOFTMAX_GRADIENT = f"""WITH l AS ({LONG}), x AS (SELECT n, i, v, label FROM l WHERE i < 4), k AS (SELECT range AS c FROM range((SELECT max(label) + 1 FROM embeddings))),
z AS (SELECT n, label, c, sum(v * {fixed_sql("i", "c", 100)}) AS z FROM x, k GROUP BY 1, 2, 3),
p AS (SELECT n, c, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) - (label = c)::INT AS e FROM z WINDOW w AS (PARTITION BY n))"""


@query(SOFTMAX_GRADIENT + " SELECT i::BIGINT AS i, c::BIGINT AS c, round(sum(v * e) / (SELECT count(*) FROM embeddings), 8) + 0.0 AS g FROM x JOIN p USING (n) GROUP BY 1, 2")
def autodiff_softmax_gradient(spark, sf):
    """The gradient of the mean cross entropy of a linear layer, by backward() on each batch and one sum over tasks."""
    df = vectors(spark, sf)
    k = df.agg(F.max("y")).first()[0] + 1

    def kernel(x, y):
        layer = ad.Linear(4, k, "zeros")
        layer.W.data = fixed_weights(4, 100)[:, :k]
        loss = ad.cross_entropy(layer(x[:, :4]), np.eye(k)[y.astype(int)]) * len(x)
        loss.backward()
        return layer.W.grad.ravel()

    g = sums(df, kernel, 4 * k, ["features", "y"]).reshape(4, k) / df.count()
    rows = [(i, c, float(g[i, c])) for i in range(4) for c in range(k)]
    return spark.createDataFrame(rows, "i long, c long, g double").select("i", "c", r6("g", "g", 8))


HEADS = """WITH t AS (SELECT vec_id, p, h, [embedding[p * 4 + h * 2 + 1]::DOUBLE, embedding[p * 4 + h * 2 + 2]::DOUBLE] AS x FROM embeddings, range(4) a(p), range(2) b(h)),
s AS (SELECT q.vec_id, q.p, q.h, k.x AS v, exp((q.x[1] * k.x[1] + q.x[2] * k.x[2]) / sqrt(2)) AS w FROM t q JOIN t k ON q.vec_id = k.vec_id AND q.h = k.h AND k.p <= q.p)
SELECT vec_id, p::INT AS p, h::INT AS h, round(sum(w * v[1]) / sum(w), 6) + 0.0 AS v0, round(sum(w * v[2]) / sum(w), 6) + 0.0 AS v1 FROM s GROUP BY 1, 2, 3"""


@query(HEADS)
def multi_head_attention(spark, sf):
    """Causal attention with two heads over the first sixteen components as four tokens, all projections the identity."""
    layer = tf.MultiHeadAttention(4, 2, random_state=0)
    layer.into.data, layer.out.W.data = np.tile(np.eye(4), 3), np.eye(4)
    out = apply_kernel(vectors(spark, sf), "features", "o", lambda x: layer(x[:, :16].reshape(-1, 4, 4), mask=tf.causal_mask(4, 4)).data.reshape(len(x), 16))
    rows = out.select(F.col("row_id").alias("vec_id"), "o", F.explode(F.expr("sequence(0, 3)")).alias("p")).select("vec_id", "o", "p", F.explode(F.expr("sequence(0, 1)")).alias("h"))
    return rows.select("vec_id", "p", "h", *(r6(F.get("o", F.expr(f"p * 4 + h * 2 + {d}")), f"v{d}") for d in range(2)))


@query("SELECT c_custkey, round(c_acctbal, 4) + 0.0 AS a, c_nationkey::DOUBLE AS b FROM customer")
def scaler_inverse(spark, sf):
    """Standardised and back."""
    df = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double")).alias("features"))
    scaler = StandardScaler().fit(df)
    out = scaler.inverse_transform(scaler.transform(df))
    return out.select("c_custkey", *(r6(F.get("features", F.lit(k)), c, 4) for k, c in enumerate("ab")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes over the embeddings: class moments in one aggregate, scoring in one projection."""
    return gaussian_nb_predict(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
