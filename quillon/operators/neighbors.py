"""k nearest neighbours: exact, by an index of cells around pivots and the triangle inequality.

The index holds the training rows by the nearest of some pivots, each cell in blocks of rows of like distance to its
pivot. A query is first compared with the cells nearest to it that hold k rows, which bounds the distance r of its k-th
neighbour; then only with cells and blocks that may hold a row within r. For a row s of the cell around p, a query q and
the cell around h nearest to q: d(q, s) >= |d(q, p) - d(s, p)| and d(q, s) >= (d(q, p) - d(q, h)) / 2, in any metric.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import expr
from quillon.functions.base import Estimator, check_frame, check_is_fitted, classes_of
from quillon.functions.held import Held
from quillon.functions.stats import matrix

BLOCK = 1024  # rows of a block
#: Bounds give way by this share, more than distances' rounding.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of a to each of b."""
    total = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        gap = a[:, c, None] - b[None, :, c]
        total += gap * gap if metric == "euclidean" else np.abs(gap)
    return np.sqrt(total) if metric == "euclidean" else total


def _lists(array: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, array.size + 1, array.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(array).ravel()))


def packed(rows: DataFrame, prefix: str, block: int = BLOCK) -> DataFrame:
    """rows(cell, dist, slack, ...) as blocks of up to `block` rows of one cell and like dist: cell, the least dist - slack and
    the greatest dist + slack as {prefix}_low and {prefix}_high, and the other columns as arrays named by the prefix."""
    others = [f for f in rows.schema.fields if f.name not in ("cell", "dist", "slack")]
    schema = T.StructType([rows.schema["cell"], T.StructField(f"{prefix}_low", T.DoubleType()), T.StructField(f"{prefix}_high", T.DoubleType()), *(T.StructField(f"{prefix}_{f.name}", T.ArrayType(f.dataType)) for f in others)])

    def run(batches):
        for batch in batches:
            cell, dist, slack = (np.asarray(batch.column(c)) for c in ("cell", "dist", "slack"))
            edges = [0, *(1 + np.flatnonzero(cell[1:] != cell[:-1])), len(cell)] if len(cell) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for lo in range(a, b, block):
                    hi = min(b, lo + block)
                    arrays = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([batch.column(f.name).slice(lo, hi - lo)])) for f in others]
                    bounds = [(dist[lo:hi] - slack[lo:hi]).min(), (dist[lo:hi] + slack[lo:hi]).max()]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[lo])], pa.int32()), *[pa.array([float(x)]) for x in bounds], *arrays], names=schema.names)

    return rows.repartitionByRange("cell", "dist").sortWithinPartitions("cell", "dist").mapInArrow(run, schema)


class KNeighborsClassifier(Estimator):
    """Ties in distance go to the smaller row_id, ties in votes to the lower class.

    Keys tell rows apart, in the training table and among the queries. Of equal training rows only the k with the smallest
    keys can be neighbours, so the index holds no more. It is a written table; close() deletes it.
    """

    def __init__(self, n_neighbors: int = 5, metric: str = "euclidean", weights: str = "uniform", max_pivots: int = 1024):
        self.n_neighbors, self.metric, self.weights, self.max_pivots = n_neighbors, metric, weights, max_pivots

    def fit(self, df: DataFrame, features: str = "features", target: str = "y", key: str = "row_id", most_classes: int = 10_000) -> KNeighborsClassifier:
        if self.metric not in expr.METRICS or self.weights not in ("uniform", "distance"):
            raise ValueError("metric is 'euclidean' or 'manhattan', weights 'uniform' or 'distance'")
        n, d = check_frame(df, features, target)
        if not 1 <= self.n_neighbors <= n:
            raise ValueError("n_neighbors must lie between 1 and the number of rows")
        self.n_features_, self.classes_ = d, classes_of(df, target, most_classes)
        self.key_type_, self.label_type_ = df.schema[key].dataType, df.schema[target].dataType
        train = df.select(F.col(key).alias("id"), F.col(features).alias("x"), F.col(target).alias("label"))
        equal = Window.partitionBy("x").orderBy("id")
        train = train.withColumn("__r", F.row_number().over(equal)).where(F.col("__r") <= self.n_neighbors).drop("__r")
        count = max(1, min(self.max_pivots, round(n**0.5)))
        drawn = train.select("x").orderBy(F.xxhash64("x")).limit(count).collect()  # at most max_pivots rows
        self.pivots_ = np.unique(np.array([r["x"] for r in drawn], float), axis=0)
        self.index_ = Held(packed(self._placed(train), "t"), "neighbours")
        sizes = np.zeros((len(self.pivots_), 3))
        for r in self.index_.df.groupBy("cell").agg(F.sum(F.size("t_id")).alias("n"), F.max("t_high").alias("far"), F.count("*").alias("blocks")).collect():  # one row a pivot
            sizes[r["cell"]] = r["n"], r["far"], r["blocks"]
        self.cell_rows_, self.cell_far_, self.cell_blocks_ = sizes.T
        self.compared_ = df.sparkSession.sparkContext.accumulator(0)
        return self

    def close(self) -> None:
        self.index_.drop()

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with the number of the nearest pivot as cell, its distance as dist, and no slack."""
        pivots, metric = self.pivots_, self.metric

        def run(batches):
            for batch in batches:
                x = matrix(batch.column("x")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
                near, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
                for lo in range(0, len(x), 256):
                    to = distances(x[lo : lo + 256], pivots, metric)
                    near[lo : lo + 256], dist[lo : lo + 256] = to.argmin(1), to.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(dist), pa.array(np.zeros(len(x)))], names=[*batch.schema.names, "cell", "dist", "slack"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("slack", T.DoubleType())]))

    def _sent(self, queries: DataFrame, first: bool) -> DataFrame:
        """queries(id, x[, r]) once for each cell to compare them with: the nearest that hold k rows, or all others within r."""
        pivots, metric, rows, far, k, compared = self.pivots_, self.metric, self.cell_rows_, self.cell_far_, self.n_neighbors, self.compared_
        schema = T.StructType([queries.schema["id"], queries.schema["x"], T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("slack", T.DoubleType())])

        def run(batches):
            for batch in batches:
                x = matrix(batch.column("x")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
                if len(x) and x.shape[1] != pivots.shape[1]:
                    raise ValueError(f"expected {pivots.shape[1]} features, got {x.shape[1]}")
                for lo in range(0, len(x), 256):
                    to = distances(x[lo : lo + 256], pivots, metric)
                    compared.add(to.size if first else 0)
                    order = np.argsort(to, 1, kind="stable")
                    enough = np.cumsum(rows[order], 1)
                    home = np.zeros(to.shape, bool)
                    np.put_along_axis(home, order, enough - rows[order] < k, 1)
                    if first:
                        go, slack = home & (rows > 0), np.full(len(to), np.inf)
                    else:
                        slack = np.asarray(batch.column("r"))[lo : lo + 256] * (1 + SLACK) + SLACK
                        least = np.maximum(to - far, (to - to.min(1, keepdims=True)) / 2)
                        go = ~home & (rows > 0) & (least <= slack[:, None])
                    q, cell = np.nonzero(go)
                    at = pa.array(lo + q)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("x").take(at), pa.array(cell.astype(np.int32)), pa.array(to[q, cell]), pa.array(slack[q])], names=schema.names)

        return queries.mapInArrow(run, schema)

    def _compared(self, sent: DataFrame) -> DataFrame:
        """(id, train_id, label, distance): the k nearest of each query in each block of training rows that it meets."""
        schema = T.StructType([T.StructField("id", sent.schema["id"].dataType), T.StructField("train_id", self.key_type_), T.StructField("label", self.label_type_), T.StructField("distance", T.DoubleType())])
        k, metric, compared = self.n_neighbors, self.metric, self.compared_
        # a cell of many blocks is dealt out in parts of eight, and its queries go to each part
        parts = F.array(*[F.lit(max(1, -(-int(b) // 8))) for b in self.cell_blocks_])
        share = F.get(parts, F.col("cell"))
        t = self.index_.df.withColumn("part", F.pmod(F.xxhash64("t_low", "t_high"), share.cast("long")))
        q = packed(sent, "q").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), share.cast("long") - 1)))
        both = q.join(t, ["cell", "part"]).where("t_high >= q_low and t_low <= q_high").select("q_id", "q_x", "t_id", "t_x", "t_label")

        def run(batches):
            for batch in batches:
                for n in range(batch.num_rows):
                    q_id, q, t_id, t, label = (batch.column(c)[n].values for c in ("q_id", "q_x", "t_id", "t_x", "t_label"))
                    q, t = matrix(q), matrix(t)
                    rank = np.argsort(np.argsort(np.asarray(t_id), kind="stable"))
                    compared.add(len(q) * len(t))
                    for lo in range(0, len(q), 256):
                        total = distances(q[lo : lo + 256], t, metric)
                        own = np.lexsort((np.broadcast_to(rank, total.shape), total))[:, :k]
                        at, mine = own.ravel(), np.repeat(np.arange(lo, lo + len(total)), own.shape[1])
                        yield pa.RecordBatch.from_arrays([q_id.take(pa.array(mine)), t_id.take(pa.array(at)), label.take(pa.array(at)), pa.array(np.take_along_axis(total, own, 1).ravel())], names=schema.names)

        return both.mapInArrow(run, schema)

    def kneighbors(self, df: DataFrame, features: str = "features", key: str = "row_id") -> DataFrame:
        """(key, train_id, label, distance, rank) of each query's n_neighbors.

        Two joins of blocks by cell: with the nearest cells, then with those that the bound leaves. Each join sends on the
        k nearest of a query and a block, never all pairs.
        """
        check_is_fitted(self, "index_")
        queries = df.select(F.col(key).alias("id"), F.col(features).alias("x"))
        first = Window.partitionBy("id").orderBy("distance", "train_id")
        nearest = lambda rows: rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= self.n_neighbors)
        near = Held(nearest(self._compared(self._sent(queries, True))), "near").df.drop("rank")
        bounded = queries.join(near.groupBy("id").agg(F.max("distance").alias("r")), "id").select("id", "x", "r")
        return nearest(near.unionByName(self._compared(self._sent(bounded, False)))).withColumnRenamed("id", key)

    def _votes(self, df, features, key):
        near = self.kneighbors(df, features, key)
        weight = F.lit(1.0)
        if self.weights == "distance":
            near = near.withColumn("__zero", F.min("distance").over(Window.partitionBy(key)) == 0)
            weight = F.when(F.col("__zero"), (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
        return near.groupBy(key, "label").agg(F.sum(weight).alias("w"))

    def predict_both(self, df: DataFrame, features: str = "features", key: str = "row_id", into: str = "prediction", proba: str = "proba") -> DataFrame:
        """(key, prediction, proba) from one search; proba by class in order."""
        shares = [F.coalesce(F.sum(F.when(F.col("label") == F.lit(c.item()), F.col("w"))), F.lit(0.0)) / F.sum("w") for c in self.classes_]
        return self._votes(df, features, key).groupBy(key).agg(F.max_by("label", F.struct("w", (-F.col("label")).alias("l"))).alias(into), F.array(*shares).alias(proba))

    def predict_proba(self, df: DataFrame, features: str = "features", key: str = "row_id", into: str = "proba") -> DataFrame:
        """(key, proba), classes in order."""
        return self.predict_both(df, features, key, proba=into).select(key, into)

    def predict(self, df: DataFrame, features: str = "features", key: str = "row_id", into: str = "prediction") -> DataFrame:
        """(key, prediction)."""
        return self.predict_both(df, features, key, into=into).select(key, into)

    def score(self, df: DataFrame, features: str = "features", target: str = "y", key: str = "row_id") -> float:
        said = self.predict(df, features, key, "__p").join(df.select(key, target), key)
        return said.agg(F.avg((F.col("__p") == F.col(target)).cast("double")).alias("v")).first()["v"]
