"""Linear models: least squares from one pass of moments, and iterated aggregates for the rest."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expr
from quillon.functions.base import ConvergenceWarning, Estimator, check_frame, check_is_fitted, classes_of, vector
from quillon.functions.stats import moments, sums, triangle
from quillon.operators import metrics


class _Linear(Estimator):
    def _margin(self, features: str) -> Column:
        check_is_fitted(self, "coef_")
        ok = F.size(features) == len(self.coef_)
        return F.when(ok, expr.dot(F.col(features), vector(self.coef_)) + float(self.intercept_)).otherwise(F.raise_error(F.lit(f"expected {len(self.coef_)} features")))


class _Regressor(_Linear):
    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        return df.withColumn(into, self._margin(features))

    def score(self, df: DataFrame, features: str = "features", target: str = "y") -> float:
        return metrics.r2_score(self.predict(df, features, "__p"), target, "__p")

    def _moments(self, df, features, target):
        """n, means of x and y, X'X, X'y and y'y about those means (about zero without an intercept)."""
        check_frame(df, features, target)
        m = moments(df, features, target)
        mean = m.mean
        s = m.scatter
        if not self.fit_intercept:
            s = s + m.n * np.outer(mean, mean)
            mean = np.zeros_like(mean)
        return m.n, mean[:-1], mean[-1], s[:-1, :-1], s[:-1, -1]

    def _descend(self, n, xm, ym, gram, cross, penalty):
        """Gradient descent from zero on [1|X]; every step needs the moments only, so all run on the driver."""
        d = len(cross)
        k = int(self.fit_intercept)
        g, c = np.zeros((d + k, d + k)), np.zeros(d + k)
        g[k:, k:], c[k:] = gram + n * np.outer(xm, xm), cross + n * xm * ym
        if k:
            g[0, 0], g[0, 1:], g[1:, 0], c[0] = n, n * xm, n * xm, n * ym
        shrink = np.r_[np.zeros(k), np.full(d, penalty)]
        theta = np.zeros(d + k)
        for self.n_iter_ in range(1, self.max_iter + 1):
            gradient = 2 / n * (g @ theta - c + shrink * theta)
            theta = theta - self.lr * gradient
            if np.abs(gradient).max() < self.tol:
                break
        else:
            warnings.warn(f"no convergence in {self.max_iter} steps", ConvergenceWarning, stacklevel=3)
        self.coef_, self.intercept_ = theta[k:], float(theta[0]) if k else 0.0


class LinearRegression(_Regressor):
    """Least squares; of several solutions that of least norm. solver: 'normal' or 'gd'."""

    def __init__(self, fit_intercept: bool = True, solver: str = "normal", lr: float = 0.01, max_iter: int = 1000, tol: float = 1e-6):
        self.fit_intercept, self.solver, self.lr, self.max_iter, self.tol = fit_intercept, solver, lr, max_iter, tol

    def fit(self, df: DataFrame, features: str = "features", target: str = "y") -> LinearRegression:
        if self.solver not in ("normal", "gd"):
            raise ValueError(f"unknown solver {self.solver!r}")
        if self.solver == "gd":
            self._descend(*self._moments(df, features, target), 0.0)
            return self
        check_frame(df, features, target)
        k = int(self.fit_intercept)
        r = triangle(df, features, target, ones=self.fit_intercept)
        theta = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]  # of least norm, the intercept counted too
        self.intercept_, self.coef_ = float(theta[0]) if k else 0.0, theta[k:]
        return self


class Ridge(_Regressor):
    """Least squares with alpha |w|^2; the intercept is not penalised."""

    def __init__(self, alpha: float = 1.0, fit_intercept: bool = True, solver: str = "normal", lr: float = 0.01, max_iter: int = 1000, tol: float = 1e-6):
        self.alpha, self.fit_intercept, self.solver, self.lr, self.max_iter, self.tol = alpha, fit_intercept, solver, lr, max_iter, tol

    def fit(self, df: DataFrame, features: str = "features", target: str = "y") -> Ridge:
        if self.alpha < 0 or self.solver not in ("normal", "gd"):
            raise ValueError("alpha must not be negative, and solver is 'normal' or 'gd'")
        n, xm, ym, gram, cross = self._moments(df, features, target)
        if self.solver == "gd":
            self._descend(n, xm, ym, gram, cross, self.alpha)
            return self
        self.coef_ = np.linalg.solve(gram + self.alpha * np.eye(len(cross)), cross)
        self.intercept_ = float(ym - xm @ self.coef_) if self.fit_intercept else 0.0
        return self


class Lasso(_Regressor):
    """|y - Xw|^2 / 2n + alpha |w|_1 by cyclic coordinate descent on the centred moments."""

    def __init__(self, alpha: float = 1.0, fit_intercept: bool = True, max_iter: int = 1000, tol: float = 1e-4):
        self.alpha, self.fit_intercept, self.max_iter, self.tol = alpha, fit_intercept, max_iter, tol

    def fit(self, df: DataFrame, features: str = "features", target: str = "y") -> Lasso:
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")
        n, xm, ym, gram, cross = self._moments(df, features, target)
        gram, cross = gram / n, cross / n
        w = np.zeros(len(cross))
        for self.n_iter_ in range(1, self.max_iter + 1):
            moved = 0.0
            for j in np.flatnonzero(np.diag(gram)):
                rho = cross[j] - gram[j] @ w + gram[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - self.alpha, 0.0) / gram[j, j]
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < self.tol:
                break
        else:
            warnings.warn(f"no convergence in {self.max_iter} sweeps", ConvergenceWarning, stacklevel=2)
        self.coef_, self.intercept_ = w, float(ym - xm @ w) if self.fit_intercept else 0.0
        return self


class _Binary(_Linear):
    def _two_classes(self, df, features, target):
        n, d = check_frame(df, features, target)
        self.classes_ = classes_of(df, target)
        if len(self.classes_) != 2:
            raise ValueError(f"two classes are needed, not {len(self.classes_)}")
        return n, d, (F.col(target) == F.lit(self.classes_[1].item())).cast("double")

    def decision_function(self, df: DataFrame, features: str = "features", into: str = "decision") -> DataFrame:
        return df.withColumn(into, self._margin(features))

    def score(self, df: DataFrame, features: str = "features", target: str = "y") -> float:
        return self.predict(df, features, "__p").agg(F.avg((F.col("__p") == F.col(target)).cast("double")).alias("v")).first()["v"]

    def _class(self, positive: Column) -> Column:
        return F.when(positive, F.lit(self.classes_[1].item())).otherwise(F.lit(self.classes_[0].item()))


class LogisticRegression(_Binary):
    """Binary; (nll + |w|^2 / 2C) / n. solver: 'newton' (one aggregate of gradient and Hessian a step) or 'gd'."""

    def __init__(self, C: float = 1.0, penalty: str | None = "l2", fit_intercept: bool = True, solver: str = "newton", lr: float = 0.1, max_iter: int = 1000, tol: float = 1e-6):
        self.C, self.penalty, self.fit_intercept, self.solver, self.lr, self.max_iter, self.tol = C, penalty, fit_intercept, solver, lr, max_iter, tol

    def fit(self, df: DataFrame, features: str = "features", target: str = "y") -> LogisticRegression:
        if self.C <= 0 or self.penalty not in ("l2", None) or self.solver not in ("newton", "gd"):
            raise ValueError("C must be positive, penalty 'l2' or None, solver 'newton' or 'gd'")
        n, d, y = self._two_classes(df, features, target)
        k = int(self.fit_intercept)
        shrink = np.r_[np.zeros(k), np.full(d, 1 / self.C if self.penalty else 0.0)]
        theta, newton = np.zeros(d + k), self.solver == "newton"
        size = (d + k) * (d + k + 1) if newton else d + k

        def kernel_at(theta):
            def kernel(x, y):
                x = np.column_stack([np.ones((len(x), k)), x])
                z = x @ theta
                p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
                g = x.T @ (p - y)
                return np.r_[g, (x.T @ (x * (p * (1 - p))[:, None])).ravel()] if newton else g

            return kernel

        for self.n_iter_ in range(1, self.max_iter + 1):
            got = sums(df, kernel_at(theta), size, [F.col(features), y])
            gradient = (got[: d + k] + shrink * theta) / n
            if newton:
                hessian = (got[d + k :].reshape(d + k, -1) + np.diag(shrink)) / n
                step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
                if 0.5 * gradient @ step < self.tol:
                    break
                theta = theta - step
            else:
                if np.abs(gradient).max() < self.tol:
                    break
                theta = theta - self.lr * gradient
        else:
            warnings.warn(f"no convergence in {self.max_iter} steps", ConvergenceWarning, stacklevel=2)
        self.coef_, self.intercept_ = theta[k:], float(theta[0]) if k else 0.0
        return self

    def predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> DataFrame:
        p = expr.sigmoid(self._margin(features))
        return df.withColumn(into, F.array(1 - p, p))

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        return df.withColumn(into, self._class(expr.sigmoid(self._margin(features)) >= 0.5))


class LinearSVM(_Binary):
    """|w|^2 / 2 + C sum of hinge losses by subgradient steps lr / sqrt(t); always max_iter of them, the best iterate stays."""

    def __init__(self, C: float = 1.0, fit_intercept: bool = True, lr: float = 0.01, max_iter: int = 1000):
        self.C, self.fit_intercept, self.lr, self.max_iter = C, fit_intercept, lr, max_iter

    def fit(self, df: DataFrame, features: str = "features", target: str = "y") -> LinearSVM:
        if self.C <= 0:
            raise ValueError("C must be positive")
        _, d, y = self._two_classes(df, features, target)
        held = df.select(F.col(features).alias("x"), (2 * y - 1).alias("s")).persist()
        w, b, best = np.zeros(d), 0.0, (np.inf, None, None)

        def kernel_at(w, b):
            def kernel(x, s):
                miss = np.maximum(1 - s * (x @ w + b), 0)
                own = s * (miss > 0)
                return np.r_[miss.sum(), own @ x, own.sum()]

            return kernel

        try:
            for t in range(1, self.max_iter + 2):
                got = sums(held, kernel_at(w, b), d + 2, ["x", "s"])
                value = 0.5 * w @ w + self.C * got[0]
                if value < best[0]:
                    best = (value, w, b)
                if t > self.max_iter:
                    break
                rate = self.lr / np.sqrt(t)
                w = w - rate * (w - self.C * got[1 : d + 1])
                b = b + rate * self.C * got[d + 1] * self.fit_intercept
        finally:
            held.unpersist()
        self.objective_, self.coef_, self.intercept_, self.n_iter_ = best[0], best[1], float(best[2]), self.max_iter
        return self

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        return df.withColumn(into, self._class(self._margin(features) >= 0))
