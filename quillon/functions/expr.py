"""Numeric expressions as Columns; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(z: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def logsumexp(z: Column) -> Column:
    """Of an array, shifted by its maximum."""
    return F.array_max(z) + F.log(total(F.transform(z, lambda x: F.exp(x - F.array_max(z)))))


def softmax(z: Column) -> Column:
    raised = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(raised, lambda x: x / total(raised))


def log_softmax(z: Column) -> Column:
    return F.transform(z, lambda x: x - logsumexp(z))


def soft_threshold(rho: Column, alpha: float) -> Column:
    return F.signum(rho) * F.greatest(F.abs(rho) - alpha, F.lit(0.0))


def relu(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0))


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Of an array, with the biased variance and eps under the root."""
    n = F.size(x)
    mean = total(x) / n
    var = total(F.transform(x, lambda v: (v - mean) * (v - mean))) / n
    return F.transform(x, lambda v: (v - mean) / F.sqrt(var + eps))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector is an error."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.raise_error(F.lit("cosine of a zero vector"))).otherwise(dot(a, b) / lengths)


METRICS = {"euclidean": euclidean, "manhattan": manhattan}

#: SQL functions by name: arguments, type and body.
SQL_FUNCTIONS = {
    "sigmoid": ("z DOUBLE", "DOUBLE", "CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END"),
    "relu": ("z DOUBLE", "DOUBLE", "greatest(z, 0D)"),
    "softplus": ("z DOUBLE", "DOUBLE", "greatest(z, 0D) + log1p(exp(-abs(z)))"),
    "gelu": ("x DOUBLE", "DOUBLE", "0.5D * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715D * x * x * x)))"),
    "array_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "euclidean_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "manhattan_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"),
    "softmax": ("z ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(z, x -> exp(x - array_max(z)) / aggregate(transform(z, v -> exp(v - array_max(z))), 0D, (s, v) -> s + v))"),
    "logsumexp": ("z ARRAY<DOUBLE>", "DOUBLE", "array_max(z) + ln(aggregate(transform(z, v -> exp(v - array_max(z))), 0D, (s, v) -> s + v))"),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
