"""Principal components from one pass, by the singular values of a tall-skinny QR factor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import expr
from quillon.functions.base import Estimator, check_frame, check_is_fitted, of_width, vector
from quillon.functions.stats import triangle


def fix_signs(axes: np.ndarray) -> np.ndarray:
    """Each row turned so that its first largest-in-size loading is positive."""
    if not len(axes):
        return axes
    largest = axes[np.arange(len(axes)), np.abs(axes).argmax(1)]
    return axes * np.where(largest < 0, -1.0, 1.0)[:, None]


def power_iteration(covariance: np.ndarray, n_components: int, rng: np.random.Generator, n_iter: int = 500, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(axes, variances), one direction after the other, each deflated away."""
    left, axes, values = covariance.copy(), [], []
    for _ in range(n_components):
        v = rng.normal(size=len(left))
        v /= np.linalg.norm(v)
        for _ in range(n_iter):
            w = left @ v
            size = np.linalg.norm(w)
            if size == 0:
                break
            w /= size
            moved = min(np.linalg.norm(w - v), np.linalg.norm(w + v))
            v = w
            if moved < tol:
                break
        value = v @ left @ v
        axes.append(v)
        values.append(value)
        left = left - value * np.outer(v, v)
    return fix_signs(np.array(axes)), np.array(values)


class PCA(Estimator):
    def __init__(self, n_components: int | None = None):
        self.n_components = n_components

    def fit(self, df: DataFrame, features: str = "features") -> PCA:
        n, d = check_frame(df, features)
        k = min(n, d) if self.n_components is None else self.n_components
        if not 1 <= k <= min(n, d) or n < 2:
            raise ValueError("n_components must lie between 1 and min(rows, features), and two rows are needed")
        r = triangle(df, features)
        _, singular, axes = np.linalg.svd(r[1:, 1:])
        values = singular**2
        self.mean_, self.components_ = r[0, 1:] / r[0, 0], fix_signs(axes[:k])
        self.singular_values_ = singular[:k]
        self.explained_variance_ = values[:k] / (n - 1)
        self.explained_variance_ratio_ = values[:k] / values.sum() if values.sum() else np.zeros(k)
        return self

    def transform(self, df: DataFrame, features: str = "features", into: str = "components") -> DataFrame:
        check_is_fitted(self, "components_")
        centred = of_width(features, len(self.mean_), F.zip_with(features, vector(self.mean_), lambda x, m: x - m))
        return df.withColumn("__c", centred).withColumn(into, F.array(*[expr.dot(F.col("__c"), vector(a)) for a in self.components_])).drop("__c")

    def fit_transform(self, df: DataFrame, features: str = "features", into: str = "components") -> DataFrame:
        return self.fit(df, features).transform(df, features, into)

    def inverse_transform(self, df: DataFrame, components: str = "components", into: str = "features") -> DataFrame:
        check_is_fitted(self, "components_")
        back = [expr.dot(F.col(components), vector(column)) + float(m) for column, m in zip(self.components_.T, self.mean_)]
        return df.withColumn(into, of_width(components, len(self.components_), F.array(*back)))

    def score(self, df: DataFrame, features: str = "features") -> float:
        """Minus the mean over rows of the squared error of reconstruction, summed over features."""
        back = self.inverse_transform(self.transform(df, features, "__z"), "__z", "__back")
        return -back.agg(F.avg(expr.squared_euclidean(F.col(features), F.col("__back"))).alias("v")).first()["v"]
