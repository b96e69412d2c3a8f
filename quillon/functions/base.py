"""Estimator protocol and input checks shared by all operators.

Data: a DataFrame with `features array<double>` and, where learned from, a target `y`; other columns ride along. Null,
NaN and infinite inputs are refused at fit, in the same aggregate that gives the sizes.
"""

from __future__ import annotations

import inspect
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFittedError(ValueError, AttributeError):
    """An operator was used before fit."""


class ConvergenceWarning(UserWarning):
    """A solver stopped before it met its tolerance; its result is kept."""


class Estimator:
    """Constructor arguments are kept as attributes of the same names and are never changed by fit."""

    def get_params(self) -> dict:
        names = [p for p in inspect.signature(type(self).__init__).parameters if p != "self"]
        return {n: getattr(self, n) for n in names}

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"


def check_is_fitted(estimator: object, *attributes: str) -> None:
    if not all(hasattr(estimator, a) for a in attributes):
        raise NotFittedError(f"{type(estimator).__name__} is not fitted")


def check_random_state(seed) -> np.random.Generator:
    """None, an integer or a Generator (shared, and advanced by its user)."""
    given = seed is None or isinstance(seed, np.random.Generator)
    try:
        return np.random.default_rng(seed if given else operator.index(seed))
    except TypeError as e:
        raise TypeError("random_state must be None, an integer or a numpy Generator") from e


def _bad(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def check_frame(df: DataFrame, features: str = "features", target: str | None = None, weight: str | None = None) -> tuple[int, int]:
    """(rows, features) of a sound input; ValueError for an empty, ragged, null, NaN or infinite one. One aggregate."""
    x = F.col(features)
    wrong = x.isNull() | F.exists(x, _bad)
    for extra in (target, weight):
        if extra is not None:
            wrong = wrong | _bad(F.col(extra).cast("double"))
    aggregates = [F.count("*").alias("n"), F.min(F.size(x)).alias("low"), F.max(F.size(x)).alias("high"), F.coalesce(F.max(wrong.cast("int")), F.lit(0)).alias("bad")]
    if weight is not None:
        aggregates += [F.min(weight).alias("least"), F.sum(weight).alias("total")]
    r = df.agg(*aggregates).first()
    if r["n"] == 0:
        raise ValueError("no rows")
    if r["bad"]:
        raise ValueError("null, NaN or infinite input")
    if r["low"] != r["high"] or r["low"] == 0:
        raise ValueError("rows differ in their number of features, or have none")
    if weight is not None and (r["least"] < 0 or r["total"] <= 0):
        raise ValueError("sample weights must be non-negative with a positive sum")
    return r["n"], r["low"]


def of_width(features: str, d: int, value: Column) -> Column:
    """value, or an error where the row has not d features (a null row gives null)."""
    size = F.size(features)
    said = F.concat(F.lit(f"expected {d} features, got "), size.cast("string"))
    return F.when(F.col(features).isNull(), F.lit(None)).when(size == d, value).otherwise(F.raise_error(said))


def vector(values) -> Column:
    """A literal array<double>."""
    return F.array(*[F.lit(float(v)) for v in values])


def feature_columns(df: DataFrame, columns: list[str], into: str = "features") -> DataFrame:
    """df with `into`, the columns as one array<double>."""
    return df.withColumn(into, F.array(*[F.col(c).cast("double") for c in columns]))


def classes_of(df: DataFrame, target: str, most: int = 10_000) -> np.ndarray:
    """The sorted distinct labels; more than `most` are an error, as models keep one entry for each."""
    rows = df.select(F.col(target).alias("y")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes")
    return np.array(sorted(r["y"] for r in rows))
