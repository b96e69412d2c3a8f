"""Scalers, one-hot encoding and exact splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.base import Estimator, check_frame, check_is_fitted, classes_of, vector
from quillon.functions.held import Held
from quillon.functions.stats import moments
from quillon.operators.density import numbered


class StandardScaler(Estimator):
    """(x - mean) / population deviation; a constant feature is divided by 1."""

    def fit(self, df: DataFrame, features: str = "features") -> StandardScaler:
        check_frame(df, features)
        m = moments(df, features)
        self.mean_ = m.mean
        spread = np.sqrt(np.maximum(np.diag(m.scatter), 0) / m.n)
        self.scale_ = np.where(spread == 0, 1.0, spread)
        return self

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        check_is_fitted(self, "mean_")
        centred = F.zip_with(features, vector(self.mean_), lambda x, m: x - m)
        return df.withColumn(features, F.zip_with(centred, vector(self.scale_), lambda x, s: x / s))

    def fit_transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return self.fit(df, features).transform(df, features)

    def inverse_transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        check_is_fitted(self, "mean_")
        raised = F.zip_with(features, vector(self.scale_), lambda x, s: x * s)
        return df.withColumn(features, F.zip_with(raised, vector(self.mean_), lambda x, m: x + m))


class MinMaxScaler(Estimator):
    """Into feature_range; a constant feature goes to its lower end, and nothing is clipped."""

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        self.feature_range = feature_range

    def fit(self, df: DataFrame, features: str = "features") -> MinMaxScaler:
        if self.feature_range[0] >= self.feature_range[1]:
            raise ValueError("feature_range must rise")
        _, d = check_frame(df, features)
        r = df.agg(*[f(F.get(features, F.lit(k))).alias(f"{n}{k}") for k in range(d) for n, f in (("a", F.min), ("b", F.max))]).first()
        self.data_min_ = np.array([r[f"a{k}"] for k in range(d)])
        self.data_max_ = np.array([r[f"b{k}"] for k in range(d)])
        return self

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        check_is_fitted(self, "data_min_")
        lo, hi = self.feature_range
        width = self.data_max_ - self.data_min_
        moved = F.zip_with(features, vector(self.data_min_), lambda x, m: x - m)
        return df.withColumn(features, F.zip_with(moved, vector(np.where(width == 0, 1.0, width)), lambda x, w: x / w * (hi - lo) + lo))

    def fit_transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return self.fit(df, features).transform(df, features)


class OneHotEncoder(Estimator):
    """A column of labels as indicator vectors over the sorted labels; an unseen label is an error that names it.

    Vectors have an entry for each label, so more than max_categories labels are an error at fit.
    """

    def __init__(self, max_categories: int = 10_000):
        self.max_categories = max_categories

    def fit(self, df: DataFrame, column: str = "y") -> OneHotEncoder:
        self.categories_ = classes_of(df, column, self.max_categories).tolist()
        if not self.categories_:
            raise ValueError("no rows")
        return self

    def transform(self, df: DataFrame, column: str = "y", into: str = "one_hot") -> DataFrame:
        check_is_fitted(self, "categories_")
        known = F.array(*[F.lit(c) for c in self.categories_])
        unseen = F.raise_error(F.concat(F.lit("unseen category: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        hot = F.transform(known, lambda c: (c == F.col(column)).cast("double"))
        return df.withColumn(into, F.when(F.coalesce(F.array_contains(known, F.col(column)), F.lit(False)), hot).otherwise(unseen))

    def fit_transform(self, df: DataFrame, column: str = "y", into: str = "one_hot") -> DataFrame:
        return self.fit(df, column).transform(df, column, into)

    def inverse_transform(self, df: DataFrame, one_hot: str = "one_hot", into: str = "y") -> DataFrame:
        check_is_fitted(self, "categories_")
        at = F.array_position(one_hot, F.array_max(one_hot)).cast("int")
        return df.withColumn(into, F.element_at(F.array(*[F.lit(c) for c in self.categories_]), at))


class SparseOneHotEncoder(Estimator):
    """Labels as (size, indices, values) by a dictionary table, for any number of labels.

    The dictionary (label, index) is a written table; labels get the ranks of their order without a sort in one task, and
    rows find theirs by a join, never through an array of all labels. close() deletes it.
    """

    def fit(self, df: DataFrame, column: str = "y") -> SparseOneHotEncoder:
        labels = df.select(F.col(column).alias("label")).where("label is not null").distinct()
        self.dictionary_ = Held(numbered(labels, "index"), "dictionary")
        self.n_categories_ = self.dictionary_.df.count()
        if not self.n_categories_:
            raise ValueError("no rows")
        return self

    def close(self) -> None:
        self.dictionary_.drop()

    def _joined(self, df: DataFrame, by, how: str) -> DataFrame:
        names = self.dictionary_.df.select(F.col("label").alias("__label"), F.col("index").alias("__index"))
        return df.join(names, by(names), how)

    def transform(self, df: DataFrame, column: str = "y", into: str = "one_hot") -> DataFrame:
        """df with a struct of size, indices and values; an unseen or null label is an error that names it."""
        check_is_fitted(self, "dictionary_")
        rows = self._joined(df, lambda t: df[column] == t["__label"], "left")
        unseen = F.raise_error(F.concat(F.lit("unseen category: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        at = F.when(F.col("__index").isNull(), unseen.cast("bigint")).otherwise(F.col("__index"))
        hot = F.struct(F.lit(self.n_categories_).cast("long").alias("size"), F.array(at).alias("indices"), F.array(F.lit(1.0)).alias("values"))
        return rows.select(*[df[c] for c in df.columns if c != into], hot.alias(into))

    def fit_transform(self, df: DataFrame, column: str = "y", into: str = "one_hot") -> DataFrame:
        return self.fit(df, column).transform(df, column, into)

    def inverse_transform(self, df: DataFrame, one_hot: str = "one_hot", into: str = "y") -> DataFrame:
        """df with the label of the first greatest value; an index outside the dictionary is an error."""
        check_is_fitted(self, "dictionary_")
        v, held = F.col(one_hot), [c for c in df.columns if c != into]
        at = F.get(v["indices"], F.array_position(v["values"], F.array_max(v["values"])).cast("int") - 1)
        rows = df.select(*held, at.alias("__at"))
        rows = self._joined(rows, lambda t: rows["__at"] == t["__index"], "left")
        label = F.when(F.col("__index").isNull(), F.raise_error(F.lit("an index is out of range")).cast(self.dictionary_.df.schema["label"].dataType)).otherwise(F.col("__label"))
        return rows.select(*held, label.alias(into))


def split_order(key: str, seed: int):
    """The order of an exact split: a hash of key and seed, then the key; any engine with md5 gives the same."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), F.col(key)


def train_test_split(df: DataFrame, test_size: float = 0.25, random_state: int = 0, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes: test has round(n * test_size) rows, the first in hash order.

    The cut is found without sorting the table: the number of rows in each of 65,536 slices of the hash gives the slice
    that holds it, and only that slice is ordered. `key` must be unique.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    mark, own = split_order(key, random_state)
    rows = df.withColumn("__mark", mark).withColumn("__slice", F.conv(F.substring("__mark", 1, 4), 16, 10).cast("int"))
    sizes = sorted((r["__slice"], r["count"]) for r in rows.groupBy("__slice").count().collect())
    n = sum(c for _, c in sizes)
    want = round(n * test_size)
    if want == 0 or want == n:
        raise ValueError("a side of the split is empty")
    before = 0
    for cut, c in sizes:
        if before + c >= want:
            break
        before += c
    inside = rows.where(F.col("__slice") == cut)
    last = inside.select("__mark", own.alias("__key")).withColumn("__n", F.row_number().over(Window.orderBy("__mark", "__key"))).where(F.col("__n") == want - before).first()
    first = (F.col("__mark") < last["__mark"]) | ((F.col("__mark") == last["__mark"]) & (F.col(key) <= F.lit(last["__key"])))
    rows = rows.drop("__slice")
    return rows.where(~first).drop("__mark"), rows.where(first).drop("__mark")


