"""Clustering: k-means and Gaussian mixtures by one aggregate a step. DBSCAN has a module of its own."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expr
from quillon.functions.base import ConvergenceWarning, Estimator, check_frame, check_is_fitted, check_random_state, of_width, vector
from quillon.functions.stats import matrix, moments, sums
from quillon.functions.streams import normals, uniform
from quillon.operators.density import DBSCAN

__all__ = ["DBSCAN", "GaussianMixture", "KMeans"]


def center_distances(features: str, centers: np.ndarray) -> Column:
    """Squared distances to a bounded list of centers, as one array expression."""
    return F.array(*[expr.squared_euclidean(F.col(features), vector(c)) for c in centers])


def first_least(distances: Column) -> Column:
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


class KMeans(Estimator):
    """Lloyd's steps; all n_init restarts advance in the same job. An empty cluster takes the farthest row left."""

    def __init__(self, n_clusters: int = 8, init="k-means++", n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, random_state=None):
        self.n_clusters, self.init, self.n_init, self.max_iter, self.tol, self.random_state = n_clusters, init, n_init, max_iter, tol, random_state

    def _starts(self, df, features, key, d, rng):
        if not isinstance(self.init, str):
            centers = np.asarray(self.init, float)
            if centers.shape != (self.n_clusters, d):
                raise ValueError("init must have a row for each cluster")
            return [centers]
        if self.init not in ("random", "k-means++"):
            raise ValueError(f"unknown init {self.init!r}")
        return [self._seeded(df, features, key, int(rng.integers(2**31)), self.init == "k-means++") for _ in range(self.n_init)]

    def _seeded(self, df, features, key, seed, by_distance):
        """Rows drawn one after the other, with weight 1 or the squared distance to those drawn: the smallest of
        exponential clocks -log(u) / weight wins, so a draw is one aggregate with no prefix sums. The clocks go by the key,
        so each of equal rows has its own; without a key column they go by the features."""
        name = key if key in df.columns else features
        chosen: list[list[float]] = []
        for k in range(self.n_clusters):
            near = F.array_min(center_distances(features, np.array(chosen))) if chosen else F.lit(1.0)
            weight = near if by_distance else F.when(near > 0, 1.0).otherwise(0.0)
            got = df.where(weight > 0).agg(F.min_by(features, -F.log(uniform(F.col(name), seed, k)) / weight).alias("x")).first()["x"]
            chosen.append(got if got is not None else chosen[0])
        return np.array(chosen)

    def fit(self, df: DataFrame, features: str = "features", key: str = "row_id") -> KMeans:
        n, d = check_frame(df, features)
        if not 1 <= self.n_clusters <= n:
            raise ValueError("n_clusters must lie between 1 and the number of rows")
        k = self.n_clusters
        rng = check_random_state(self.random_state)
        m = moments(df, features)
        limit = self.tol * np.diag(m.scatter).mean() / m.n
        runs = self._starts(df, features, key, d, rng)
        state = [{"centers": c, "open": True, "iterations": 0} for c in runs]

        def kernel_of(all_centers):
            def kernel(x):
                out = []
                for centers in all_centers:
                    dist = ((x[:, None, :] - centers[None]) ** 2).sum(2)
                    label = dist.argmin(1)
                    hot = np.eye(k)[label]
                    out += [(hot.T @ x).ravel(), hot.sum(0), [dist[np.arange(len(x)), label].sum()]]
                return np.concatenate(out)

            return kernel

        width = k * d + k + 1
        for _ in range(self.max_iter):
            going = [s for s in state if s["open"]]
            if not going:
                break
            got = sums(df, kernel_of([s["centers"] for s in going]), width * len(going), [features]).reshape(len(going), width)
            for s, row in zip(going, got):
                total, count = row[: k * d].reshape(k, d), row[k * d : k * d + k]
                empty = np.flatnonzero(count == 0)
                if len(empty):
                    total, count = self._relocate(df, features, key, s["centers"], total.copy(), count.copy(), empty)
                new = total / count[:, None]
                s["iterations"] += 1
                s["open"] = ((new - s["centers"]) ** 2).sum() > limit
                s["centers"] = new
        got = sums(df, kernel_of([s["centers"] for s in state]), width * len(state), [features]).reshape(len(state), width)
        best = min(range(len(state)), key=lambda i: got[i, -1])
        self.cluster_centers_, self.inertia_, self.n_iter_ = state[best]["centers"], float(got[best, -1]), state[best]["iterations"]
        return self

    def _relocate(self, df, features, key, centers, total, count, empty):
        """Empty clusters, in order, each take the farthest row not yet taken, which leaves its old cluster."""
        rows = df.withColumn("__d", center_distances(features, centers)).select(F.col(features).alias("x"), first_least(F.col("__d")).alias("c"), F.array_min("__d").alias("d"), F.col(key).alias("id"))
        for k, r in zip(empty, rows.orderBy(F.desc("d"), "id").limit(len(empty)).collect()):
            x = np.array(r["x"])
            total[r["c"]] -= x
            count[r["c"]] -= 1
            total[k], count[k] = x, 1
        count[count == 0] = 1
        return total, count

    def transform(self, df: DataFrame, features: str = "features", into: str = "distances") -> DataFrame:
        check_is_fitted(self, "cluster_centers_")
        return df.withColumn(into, F.transform(self._distances(features), F.sqrt))

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        check_is_fitted(self, "cluster_centers_")
        return df.withColumn("__d", self._distances(features)).withColumn(into, first_least(F.col("__d"))).drop("__d")

    def _distances(self, features):
        return of_width(features, self.cluster_centers_.shape[1], center_distances(features, self.cluster_centers_))

    def fit_predict(self, df: DataFrame, features: str = "features", key: str = "row_id") -> DataFrame:
        return self.fit(df, features, key).predict(df, features)

    def fit_transform(self, df: DataFrame, features: str = "features", key: str = "row_id") -> DataFrame:
        return self.fit(df, features, key).transform(df, features)

    def score(self, df: DataFrame, features: str = "features") -> float:
        check_is_fitted(self, "cluster_centers_")
        return -df.agg(F.sum(F.array_min(self._distances(features))).alias("v")).first()["v"]


COVARIANCES = ("full", "tied", "diag", "spherical")


def log_density(x: np.ndarray, means: np.ndarray, covariances: np.ndarray, kind: str) -> np.ndarray:
    """(rows, components) of log N(x; mean, covariance); a covariance that is not positive definite is an error."""
    d = x.shape[1]
    out = np.empty((len(x), len(means)))
    for k, mean in enumerate(means):
        diff = x - mean
        if kind in ("full", "tied"):
            try:
                low = np.linalg.cholesky(covariances if kind == "tied" else covariances[k])
            except np.linalg.LinAlgError as e:
                raise ValueError("a covariance is not positive definite; raise reg_covar") from e
            z = np.linalg.solve(low, diff.T)
            out[:, k] = -0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum()
        else:
            var = np.broadcast_to(covariances[k], (d,))
            out[:, k] = -0.5 * (diff**2 / var).sum(1) - 0.5 * np.log(var).sum()
    return out - 0.5 * d * math.log(2 * math.pi)


def _log_sum(z):
    top = z.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(z - top).sum(1))


class GaussianMixture(Estimator):
    """Expectation maximisation; a step is one aggregate of responsibilities and their moments about the old means."""

    def __init__(self, n_components: int = 1, covariance_type: str = "full", tol: float = 1e-3, reg_covar: float = 1e-6, max_iter: int = 100, n_init: int = 1, init_params="kmeans", random_state=None):
        self.n_components, self.covariance_type, self.tol, self.reg_covar, self.max_iter, self.n_init, self.init_params, self.random_state = n_components, covariance_type, tol, reg_covar, max_iter, n_init, init_params, random_state

    def _step(self, df, features, weigh, d, center):
        """New (weights, means, covariances) and the mean of a score, from weigh(x) -> (responsibilities, score)."""
        k, kind = self.n_components, self.covariance_type
        wide = kind in ("full", "tied")
        each = d * d if wide else d

        def kernel(x):
            resp, score = weigh(x)
            out = [resp.sum(0)]
            for c in range(k):
                diff = x - center[c]
                r = resp[:, c : c + 1]
                out += [(r * diff).sum(0), ((r * diff).T @ diff).ravel() if wide else (r * diff**2).sum(0)]
            return np.concatenate([*out, [score.sum(), len(x)]])

        got = sums(df, kernel, k + k * (d + each) + 2, [features])
        n = got[-1]
        count = got[:k] + 10 * np.finfo(float).eps
        rest = got[k:-2].reshape(k, d + each)
        shift = rest[:, :d] / count[:, None]
        means = center + shift
        cov = []
        for c in range(k):
            b, s, dm, big = rest[c, :d], rest[c, d:], shift[c], got[c]
            cov.append(s.reshape(d, d) - np.outer(b, dm) - np.outer(dm, b) + big * np.outer(dm, dm) if wide else s - 2 * b * dm + big * dm**2)
        cov = np.array(cov)
        if kind == "full":
            cov = cov / count[:, None, None] + self.reg_covar * np.eye(d)
        elif kind == "tied":
            cov = cov.sum(0) / n + self.reg_covar * np.eye(d)
        else:
            cov = cov / count[:, None] + self.reg_covar
            if kind == "spherical":
                cov = cov.mean(1)
        return (count / n, means, cov), got[-2] / n

    def _weigh(self, params):
        weights, means, cov = params
        kind = self.covariance_type

        def weigh(x):
            joint = np.log(weights) + log_density(x, means, cov if kind != "spherical" else cov[:, None], kind)
            total = _log_sum(joint)
            return np.exp(joint - total[:, None]), total

        return weigh

    def fit(self, df: DataFrame, features: str = "features", key: str = "row_id") -> GaussianMixture:
        n, d = check_frame(df, features)
        if self.covariance_type not in COVARIANCES or not 1 <= self.n_components <= n:
            raise ValueError("covariance_type is one of " + ", ".join(COVARIANCES) + "; n_components lies between 1 and the rows")
        rng = check_random_state(self.random_state)
        best = None
        for _ in range(self.n_init):
            if isinstance(self.init_params, tuple):
                params = tuple(np.asarray(p, float) for p in self.init_params)
            else:
                if self.init_params == "kmeans":
                    centers = KMeans(self.n_components, n_init=1, random_state=rng).fit(df, features, key).cluster_centers_
                    start = lambda x, c=centers: (np.eye(len(c))[((x[:, None] - c) ** 2).sum(2).argmin(1)], np.zeros(len(x)))
                elif self.init_params == "random":
                    turn = rng.normal(size=(d, self.n_components)) * 37

                    def start(x, turn=turn):
                        r = np.abs(np.sin(x @ turn) * 43758.5453) % 1 + 1e-3
                        return r / r.sum(1, keepdims=True), np.zeros(len(x))

                    centers = np.repeat(moments(df, features).mean[None], self.n_components, 0)
                else:
                    raise ValueError(f"unknown init_params {self.init_params!r}")
                params, _ = self._step(df, features, start, d, centers)
            bound, settled = -np.inf, False
            for step in range(1, self.max_iter + 1):
                new, value = self._step(df, features, self._weigh(params), d, params[1])
                params, rise, bound = new, value - bound, value
                if rise < self.tol:
                    settled = True
                    break
            if not settled:
                warnings.warn(f"no convergence in {self.max_iter} steps", ConvergenceWarning, stacklevel=2)
            if best is None or bound > best[0]:
                best = (bound, params, step, settled)
        self.lower_bound_, (self.weights_, self.means_, self.covariances_), self.n_iter_, self.converged_ = best
        return self

    def _score_columns(self, df: DataFrame, features: str) -> DataFrame:
        """df with __resp and __logp, by one Arrow kernel."""
        check_is_fitted(self, "means_")
        import pyarrow as pa
        from pyspark.sql import types as T

        weigh = self._weigh((self.weights_, self.means_, self.covariances_))
        schema = T.StructType([*df.schema.fields, T.StructField("__resp", T.ArrayType(T.DoubleType())), T.StructField("__logp", T.DoubleType())])

        def run(batches):
            for batch in batches:
                resp, logp = weigh(matrix(batch.column(features))) if batch.num_rows else (np.zeros((0, 1)), np.zeros(0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(resp.tolist(), pa.list_(pa.float64())), pa.array(logp)], names=[*batch.schema.names, "__resp", "__logp"])

        return df.mapInArrow(run, schema)

    def predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> DataFrame:
        return self._score_columns(df, features).withColumnRenamed("__resp", into).drop("__logp")

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        got = self._score_columns(df, features)
        return got.withColumn(into, (F.array_position("__resp", F.array_max("__resp")) - 1).cast("int")).drop("__resp", "__logp")

    def fit_predict(self, df: DataFrame, features: str = "features", key: str = "row_id") -> DataFrame:
        return self.fit(df, features, key).predict(df, features)

    def score_samples(self, df: DataFrame, features: str = "features", into: str = "log_prob") -> DataFrame:
        return self._score_columns(df, features).withColumnRenamed("__logp", into).drop("__resp")

    def score(self, df: DataFrame, features: str = "features") -> float:
        return self._score_columns(df, features).agg(F.avg("__logp").alias("v")).first()["v"]

    def n_parameters(self) -> int:
        check_is_fitted(self, "means_")
        k, d = self.means_.shape
        return k - 1 + k * d + {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.covariance_type]

    def bic(self, df: DataFrame, features: str = "features") -> float:
        n = df.count()
        return -2 * n * self.score(df, features) + self.n_parameters() * math.log(n)

    def aic(self, df: DataFrame, features: str = "features") -> float:
        return -2 * df.count() * self.score(df, features) + 2 * self.n_parameters()

    def sample(self, spark, n_samples: int = 1, partitions: int | None = None) -> DataFrame:
        """(row_id, features, component), grouped by component; the same rows at each call with an integer random_state.

        Only the number of rows of each component is drawn here; the rows are drawn by their numbers, where they are.
        """
        check_is_fitted(self, "means_")
        rng = check_random_state(self.random_state)
        (k, d), kind = self.means_.shape, self.covariance_type
        ends = np.cumsum(rng.multinomial(n_samples, self.weights_ / self.weights_.sum()))
        seed = int(rng.integers(2**31))
        whole = {"full": lambda c: self.covariances_[c], "tied": lambda c: self.covariances_, "diag": lambda c: np.diag(self.covariances_[c]), "spherical": lambda c: np.eye(d) * self.covariances_[c]}[kind]
        lower = [np.linalg.cholesky(whole(c)) for c in range(k)]
        component = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= F.col("row_id")))
        rows = spark.range(0, n_samples, 1, partitions).withColumnRenamed("id", "row_id").withColumn("component", component.cast("int"))
        rows = rows.withColumn("__z", normals(F.col("row_id"), seed, d))
        own = lambda tables: F.get(F.array(*tables), F.col("component"))
        features = [own([F.lit(float(m)) for m in self.means_[:, j]]) + expr.dot(own([vector(low[j]) for low in lower]), F.col("__z")) for j in range(d)]
        return rows.select("row_id", F.array(*features).alias("features"), "component")
