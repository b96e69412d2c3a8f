"""Gaussian naive Bayes: per-class moments in one aggregate, scoring as one projection against the class table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expr
from quillon.functions.base import Estimator, check_frame, check_is_fitted, vector


class GaussianNB(Estimator):
    def __init__(self, *, priors=None, var_smoothing: float = 1e-9, max_classes: int = 10_000):
        self.priors, self.var_smoothing, self.max_classes = priors, var_smoothing, max_classes

    def fit(self, df: DataFrame, features: str = "features", target: str = "y") -> GaussianNB:
        """Population variances plus var_smoothing times the largest variance of any feature over all rows.

        The model has a row for each class: more than max_classes are an error.
        """
        if self.var_smoothing < 0:
            raise ValueError("var_smoothing must not be negative")
        n, d = check_frame(df, features, target)
        x = [F.get(features, F.lit(k)) for k in range(d)]
        each = [a for k in range(d) for a in (F.avg(x[k]).alias(f"m{k}"), F.var_pop(x[k]).alias(f"v{k}"))]
        rows = sorted(df.groupBy(F.col(target).alias("y")).agg(F.count("*").alias("n"), *each).limit(self.max_classes + 1).collect(), key=lambda r: r["y"])
        if len(rows) > self.max_classes:
            raise ValueError(f"more than {self.max_classes} classes")
        self.classes_ = np.array([r["y"] for r in rows])
        self.class_count_ = np.array([r["n"] for r in rows], float)
        self.theta_ = np.array([[r[f"m{k}"] for k in range(d)] for r in rows])
        within = np.array([[r[f"v{k}"] for k in range(d)] for r in rows])
        share = self.class_count_ / n
        whole = share @ (within + (self.theta_ - share @ self.theta_) ** 2)
        self.epsilon_ = self.var_smoothing * whole.max()
        self.var_ = within + self.epsilon_
        if self.priors is None:
            self.class_prior_ = share
        else:
            given = np.asarray(self.priors, float)
            if given.shape != share.shape or (given < 0).any() or not np.isclose(given.sum(), 1):
                raise ValueError("priors must be non-negative, one for each class, and sum to 1")
            self.class_prior_ = given
        return self

    def _joint(self, features: str) -> Column:
        check_is_fitted(self, "theta_")
        x = F.col(features)
        out = []
        for prior, mean, var in zip(self.class_prior_, self.theta_, self.var_):
            base = (np.log(prior) if prior > 0 else -np.inf) - 0.5 * np.log(2 * np.pi * var).sum()
            squares = F.zip_with(x, vector(mean), lambda a, m: (a - m) * (a - m))
            out.append(F.lit(float(base)) - 0.5 * expr.total(F.zip_with(squares, vector(var), lambda a, v: a / v)))
        ok = F.size(x) == self.theta_.shape[1]
        return F.when(ok, F.array(*out)).otherwise(F.raise_error(F.lit(f"expected {self.theta_.shape[1]} features")))

    def joint_log_likelihood(self, df: DataFrame, features: str = "features", into: str = "jll") -> DataFrame:
        return df.withColumn(into, self._joint(features))

    def predict_log_proba(self, df: DataFrame, features: str = "features", into: str = "log_proba") -> DataFrame:
        return df.withColumn("__j", self._joint(features)).withColumn(into, expr.log_softmax(F.col("__j"))).drop("__j")

    def predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> DataFrame:
        return df.withColumn("__j", self._joint(features)).withColumn(into, expr.softmax(F.col("__j"))).drop("__j")

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        """The first of the most likely classes."""
        names = F.array(*[F.lit(c.item()) for c in self.classes_])
        return df.withColumn("__j", self._joint(features)).withColumn(into, F.element_at(names, F.array_position("__j", F.array_max("__j")).cast("int"))).drop("__j")

    def score(self, df: DataFrame, features: str = "features", target: str = "y") -> float:
        return self.predict(df, features, "__p").agg(F.avg((F.col("__p") == F.col(target)).cast("double")).alias("v")).first()["v"]


