"""Metrics as single aggregates, and all-pairs distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expr


def _ints(y_true: str, y_pred: str) -> tuple[Column, Column]:
    return F.col(y_true).cast("double").cast("bigint"), F.col(y_pred).cast("double").cast("bigint")


def accuracy(y_true: str, y_pred: str) -> Column:
    a, b = _ints(y_true, y_pred)
    return F.avg((a == b).cast("double"))


def accuracy_score(df: DataFrame, y_true: str = "y", y_pred: str = "prediction") -> float:
    return df.agg(accuracy(y_true, y_pred).alias("v")).first()["v"]


def confusion_matrix(df: DataFrame, y_true: str = "y", y_pred: str = "prediction") -> DataFrame:
    """(y_true, y_pred, n) for every two labels that occur on either side; absent pairs have 0."""
    a, b = _ints(y_true, y_pred)
    counts = df.groupBy(a.alias("y_true"), b.alias("y_pred")).agg(F.count("*").alias("n"))
    labels = counts.select(F.col("y_true").alias("label")).union(counts.select(F.col("y_pred").alias("label"))).distinct()
    # The result has a row for every two labels; Spark weighs the sides before it broadcasts one.
    grid = labels.select(F.col("label").alias("y_true")).crossJoin(labels.select(F.col("label").alias("y_pred")))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _counts(y_true: str, y_pred: str, positive: int) -> tuple[Column, Column, Column]:
    a, b = _ints(y_true, y_pred)
    return F.count_if((a == positive) & (b == positive)), F.count_if((a != positive) & (b == positive)), F.count_if((a == positive) & (b != positive))


def precision(y_true: str = "y", y_pred: str = "prediction", positive_label: int = 1) -> Column:
    tp, fp, _ = _counts(y_true, y_pred, positive_label)
    return _ratio(tp, tp + fp)


def recall(y_true: str = "y", y_pred: str = "prediction", positive_label: int = 1) -> Column:
    tp, _, fn = _counts(y_true, y_pred, positive_label)
    return _ratio(tp, tp + fn)


def f1(y_true: str = "y", y_pred: str = "prediction", positive_label: int = 1) -> Column:
    tp, fp, fn = _counts(y_true, y_pred, positive_label)
    return _ratio(2 * tp, 2 * tp + fp + fn)


def precision_score(df: DataFrame, y_true: str = "y", y_pred: str = "prediction", positive_label: int = 1) -> float:
    return df.agg(precision(y_true, y_pred, positive_label).alias("v")).first()["v"]


def recall_score(df: DataFrame, y_true: str = "y", y_pred: str = "prediction", positive_label: int = 1) -> float:
    return df.agg(recall(y_true, y_pred, positive_label).alias("v")).first()["v"]


def f1_score(df: DataFrame, y_true: str = "y", y_pred: str = "prediction", positive_label: int = 1) -> float:
    return df.agg(f1(y_true, y_pred, positive_label).alias("v")).first()["v"]


def mean_squared_error(y_true: str = "y", y_pred: str = "prediction") -> Column:
    return F.avg((F.col(y_true) - F.col(y_pred)) * (F.col(y_true) - F.col(y_pred)))


def root_mean_squared_error(y_true: str = "y", y_pred: str = "prediction") -> Column:
    return F.sqrt(mean_squared_error(y_true, y_pred))


def mean_absolute_error(y_true: str = "y", y_pred: str = "prediction") -> Column:
    return F.avg(F.abs(F.col(y_true) - F.col(y_pred)))


def r2(y_true: str = "y", y_pred: str = "prediction") -> Column:
    """1 - residual / total sum of squares; an error for a constant target."""
    spread = F.var_pop(F.col(y_true).cast("double"))
    return F.when(spread == 0, F.raise_error(F.lit("r2 of a constant target"))).otherwise(1 - mean_squared_error(y_true, y_pred) / spread)


def r2_score(df: DataFrame, y_true: str = "y", y_pred: str = "prediction") -> float:
    row = df.agg(mean_squared_error(y_true, y_pred).alias("e"), F.var_pop(F.col(y_true).cast("double")).alias("s")).first()
    if row["s"] == 0:
        raise ValueError("r2 of a constant target")
    return 1 - row["e"] / row["s"]


def pairwise(a: DataFrame, b: DataFrame, metric, into: str = "distance") -> DataFrame:
    """metric of every row of a(a_id, a) with every row of b(b_id, b): the stated result has that many rows.

    b is the stated query side; Catalyst broadcasts it if it is small and pairs partitions otherwise.
    """
    return a.crossJoin(b).select("a_id", "b_id", metric(F.col("a"), F.col("b")).alias(into))


def euclidean_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    return pairwise(a, b, expr.euclidean)


def manhattan_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    return pairwise(a, b, expr.manhattan)


def cosine_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    return pairwise(a, b, expr.cosine, "similarity")
