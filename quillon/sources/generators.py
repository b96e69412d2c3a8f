"""Synthetic tables: exact NumPy draws for small ones, draws by row number where the rows are for large ones."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expr
from quillon.functions.base import check_random_state, vector
from quillon.functions.streams import normal, normals, uniform

SCHEMA = "row_id long, features array<double>, y double"


def _frame(spark: SparkSession, x: np.ndarray, y: np.ndarray, whole: bool = False) -> DataFrame:
    rows = [(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("y", F.col("y").cast("long")) if whole else df


def _positive(**values: int) -> None:
    for name, v in values.items():
        if v < 1:
            raise ValueError(f"{name} must be positive")


def make_regression(spark: SparkSession, n_samples: int = 100, n_features: int = 1, noise: float = 0.0, random_state=None) -> DataFrame:
    """y = X w + b + noise, with X, w, b and the noise drawn in this order."""
    _positive(n_samples=n_samples, n_features=n_features)
    rng = check_random_state(random_state)
    x, w, b = rng.normal(size=(n_samples, n_features)), rng.normal(size=n_features), rng.normal()
    return _frame(spark, x, x @ w + b + (rng.normal(0, noise, n_samples) if noise else 0))


def make_blobs(spark: SparkSession, n_samples: int = 100, n_features: int = 2, centers: int = 3, cluster_std: float = 1.0, random_state=None) -> DataFrame:
    """Rows grouped by cluster; the first clusters take the remainder."""
    _positive(n_samples=n_samples, n_features=n_features, centers=centers)
    rng = check_random_state(random_state)
    mid = rng.uniform(-10, 10, (centers, n_features))
    sizes = [n_samples // centers + (k < n_samples % centers) for k in range(centers)]
    x = np.concatenate([rng.normal(m, cluster_std, (n, n_features)) for m, n in zip(mid, sizes)])
    return _frame(spark, x, np.repeat(np.arange(centers), sizes), True)


def make_moons(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, random_state=None) -> DataFrame:
    """Two half circles: (cos t, sin t), label 0, and (1 - cos t, 0.5 - sin t), label 1."""
    _positive(n_samples=n_samples)
    rng = check_random_state(random_state)
    n = n_samples // 2
    t, u = rng.uniform(0, math.pi, n), rng.uniform(0, math.pi, n_samples - n)
    x = np.concatenate([np.column_stack([np.cos(t), np.sin(t)]), np.column_stack([1 - np.cos(u), 0.5 - np.sin(u)])])
    return _frame(spark, x + (rng.normal(0, noise, x.shape) if noise else 0), np.r_[np.zeros(n), np.ones(n_samples - n)], True)


def large_blobs(spark: SparkSession, n_samples: int, n_features: int = 2, centers: int = 3, cluster_std: float = 1.0, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Blobs drawn where the rows are, by row number: the same rows for any number of partitions."""
    _positive(n_samples=n_samples, n_features=n_features, centers=centers)
    mid = np.random.default_rng(seed).uniform(-10, 10, (centers, n_features))
    rows = spark.range(0, n_samples, 1, partitions).withColumnRenamed("id", "row_id").withColumn("y", F.floor(F.col("row_id") * centers / n_samples).cast("long"))
    own = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in mid]), F.col("y").cast("int"))
    return rows.select("row_id", F.zip_with(own, normals(F.col("row_id"), seed, n_features), lambda m, z: m + cluster_std * z).alias("features"), "y")


def large_regression(spark: SparkSession, n_samples: int, n_features: int = 1, noise: float = 0.0, seed: int = 0, partitions: int | None = None) -> DataFrame:
    _positive(n_samples=n_samples, n_features=n_features)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=n_features), float(rng.normal())
    rows = spark.range(0, n_samples, 1, partitions).select(F.col("id").alias("row_id"), normals(F.col("id"), seed, n_features).alias("features"))
    return rows.withColumn("y", expr.dot(F.col("features"), vector(w)) + b + noise * normal(F.col("row_id"), seed, n_features))


def large_moons(spark: SparkSession, n_samples: int, noise: float = 0.0, seed: int = 0, partitions: int | None = None) -> DataFrame:
    _positive(n_samples=n_samples)
    rows = spark.range(0, n_samples, 1, partitions).select(F.col("id").alias("row_id"), (F.col("id") >= n_samples // 2).cast("long").alias("y"), (uniform(F.col("id"), seed, 0) * math.pi).alias("t"))
    x = F.when(F.col("y") == 0, F.cos("t")).otherwise(1 - F.cos("t"))
    z = F.when(F.col("y") == 0, F.sin("t")).otherwise(0.5 - F.sin("t"))
    return rows.select("row_id", F.array(x + noise * normal(F.col("row_id"), seed, 1), z + noise * normal(F.col("row_id"), seed, 2)).alias("features"), "y")


def blobs_for(rows: DataFrame, key: str, component: str, centers: list[list[float]], cluster_std: float = 1.0, seed: int = 0) -> DataFrame:
    """rows with features: for each row of a table a point around the centre that its component names."""
    own = F.get(F.array(*[vector(m) for m in centers]), F.col(component).cast("int"))
    return rows.withColumn("features", F.zip_with(own, normals(F.col(key), seed, len(centers[0])), lambda m, z: m + cluster_std * z))
