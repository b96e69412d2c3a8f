"""DBSCAN on a graph of cells.

Rows fall into cells so small that any two rows of one are neighbours: a cell of min_samples rows holds core rows only, and
all core rows of a cell are in one cluster. So the graph has cells for nodes, and rows are compared only where a cell is
too sparse to decide by its count (fewer than min_samples rows each) or where two core cells are not yet known to be in
one cluster. Cells are kept by their whole coordinates, in all dimensions, and only those that hold rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import expr
from quillon.functions.base import Estimator, check_frame
from quillon.functions.held import Held
from quillon.functions.stats import matrix
from quillon.operators.neighbors import distances

#: Rows of a block, and rows of a cell that are tried first for a link to another cell.
BLOCK, TRIED = 1024, 64
#: Cells are smaller by this share than needed, and boxes closer, so that rounding can't lose a neighbour.
SLACK = 1e-9


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest reachable node: minimum labels travel along edges(a, b) and jump. Each round is written."""
    sym = Held(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = Held(sym.df.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).withColumnRenamed("a", "node"), "labels")
    while True:
        label = now.df.select("node", "c")
        near = sym.df.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("c").alias("n")).withColumnRenamed("a", "node")
        new = label.join(near, "node").select("node", F.least("c", "n").alias("c"), F.col("c").alias("old"))
        jump = label.select(F.col("node").alias("c"), F.col("c").alias("j"))
        last, now = now, Held(new.join(jump, "c").select("node", F.least("c", "j").alias("c"), "old"), "labels")
        last.drop()
        if not now.df.where("c != old").limit(1).count():
            sym.drop()
            return now.df.select("node", F.col("c").alias("component"))


def numbered(values: DataFrame, name: str) -> DataFrame:
    """The one column of values with its rank from 0 as `name`: ranks within ranges, shifted by the rows of earlier ranges."""
    (column,) = values.columns
    schema = T.StructType([values.schema[column], T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], names=schema.names)
            seen += n

    ranked = Held(values.repartitionByRange(column).sortWithinPartitions(column).mapInArrow(run, schema), "ranks").df
    counts = {r["part"]: r["count"] for r in ranked.groupBy("part").count().collect()}  # one row a partition
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    start = F.get(F.array(*[F.lit(int(s)) for s in starts]).cast("array<bigint>"), F.col("part")) if starts else F.lit(0)
    return ranked.select(column, (F.col("at") + start).alias(name))


def _gap(a: Column, b: Column, side: float, metric: str) -> Column:
    """The least distance of two cells' boxes."""
    steps = F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)) * F.lit(side))
    return F.sqrt(expr.total(F.transform(steps, lambda v: v * v))) if metric == "euclidean" else expr.total(steps)


def _blocks(rows: DataFrame, prefix: str) -> DataFrame:
    """rows(cell, id, x) as blocks of up to BLOCK rows of a cell: {prefix}, the ids and vectors, and the box that they fill."""
    schema = T.StructType([T.StructField(prefix, rows.schema["cell"].dataType), T.StructField(f"{prefix}_id", T.ArrayType(rows.schema["id"].dataType)), T.StructField(f"{prefix}_x", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField(f"{prefix}_low", T.ArrayType(T.DoubleType())), T.StructField(f"{prefix}_high", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, x = batch.column("cell"), matrix(batch.column("x"))
            keys = np.asarray(cell.flatten()).reshape(len(cell), -1)
            edges = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1))), len(x)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for lo in range(a, b, BLOCK):
                    n = min(b - lo, BLOCK)
                    ends = pa.array([0, n], pa.int32())
                    arrays = [pa.ListArray.from_arrays(ends, pa.concat_arrays([batch.column(c).slice(lo, n)])) for c in ("id", "x")]
                    own = x[lo : lo + n]
                    yield pa.RecordBatch.from_arrays([cell.slice(lo, 1), *arrays, pa.array([own.min(0).tolist()]), pa.array([own.max(0).tolist()])], names=schema.names)

    return rows.select("cell", "id", "x").repartitionByRange("cell", "x").sortWithinPartitions("cell", "x").mapInArrow(run, schema)


class DBSCAN(Estimator):
    """Density clusters. A cluster is a component of core rows; clusters are numbered by their smallest core row_id, and
    a border row joins the first of its neighbours' clusters; noise is -1. Euclidean or Manhattan; row_ids must differ."""

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean"):
        self.eps, self.min_samples, self.metric = eps, min_samples, metric

    def fit(self, df: DataFrame, features: str = "features", key: str = "row_id") -> DBSCAN:
        if self.eps <= 0 or self.min_samples < 1 or self.metric not in expr.METRICS:
            raise ValueError("eps must be positive, min_samples at least 1, metric known")
        _, d = check_frame(df, features)
        self.compared_ = df.sparkSession.sparkContext.accumulator(0)
        side = self.eps / (d**0.5 if self.metric == "euclidean" else d) * (1 - SLACK)
        cell = F.transform("x", lambda v: F.floor(v / side))
        rows = Held(df.select(F.col(key).alias("id"), F.col(features).alias("x")).withColumn("cell", cell), "rows").df
        sizes = Held(rows.groupBy("cell").agg(F.count("*").alias("n")), "cells").df
        near = Held(self._near_cells(rows, sizes, side, d), "near").df
        sparse = rows.join(sizes.where(F.col("n") < self.min_samples), "cell").select("cell", "id", "x")

        # a row of a sparse cell is core if it has enough neighbours; all others are core by their cell's count
        counted = self._beside(sparse, near, sizes, _blocks(rows, "b"), None)
        enough = counted.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_samples).select("id")
        dense = rows.join(sizes.where(F.col("n") >= self.min_samples), "cell").select("cell", "id", "x")
        core = Held(dense.unionByName(sparse.join(enough, "id").select("cell", "id", "x")), "core").df

        nodes = Held(core.groupBy("cell").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes").df
        groups = self._groups(core, nodes, near)
        of_cell = Held(nodes.join(groups, "node").select("cell", "component"), "groups").df
        number = numbered(of_cell.select("component").distinct(), "label")
        label = Held(of_cell.join(number, "component").select("cell", "label"), "cell-labels").df

        inside = core.join(label, "cell").select("id", "label")
        loose = sparse.join(core.select("id"), "id", "left_anti").select("cell", "id", "x")
        claims = self._beside(loose, near, sizes, _blocks(core, "b"), label)
        border = claims.where("n > 0").groupBy("id").agg(F.min("label").alias("label"))
        placed = inside.unionByName(border).withColumnRenamed("id", key)
        self.labels_ = df.select(key).join(placed, key, "left").select(key, F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
        self.core_sample_indices_ = core.select(F.col("id").alias(key))
        self.components_ = core.select(F.col("id").alias(key), F.col("x").alias(features))
        return self

    def _near_cells(self, rows: DataFrame, sizes: DataFrame, side: float, d: int) -> DataFrame:
        """(a, b): every two cells, a cell with itself included, whose boxes come within eps of each other.

        Cells meet on a grid of side 2 * eps over the three features that spread most; boxes within eps lie in neighbouring
        squares of it, as a cell's side is at most eps.
        """
        spread = rows.select(*[F.stddev_pop(F.get("x", F.lit(k))).alias(str(k)) for k in range(d)]).first()
        axes = sorted(sorted(range(d), key=lambda k: -spread[str(k)])[:3])
        square = lambda moves: F.array(*[F.floor(F.get("cell", F.lit(k)) * side / (2 * self.eps)) + m for k, m in zip(axes, moves, strict=True)])
        cells = sizes.select("cell")
        a = cells.select(F.col("cell").alias("a"), F.explode(F.array(*[square(m) for m in product((-1, 0, 1), repeat=len(axes))])).alias("square"))
        b = cells.select(F.col("cell").alias("b"), square([0] * len(axes)).alias("square"))
        return a.join(b, "square").where(_gap(F.col("a"), F.col("b"), side, self.metric) <= self.eps * (1 + SLACK)).select("a", "b")

    def _beside(self, rows: DataFrame, near: DataFrame, sizes: DataFrame, blocks: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(id, n[, label]): for each row and block of a cell beside its own, how many rows of the block are neighbours.

        rows are those of sparse cells, fewer than min_samples in each, so they go as one list a cell. The blocks of a full
        cell are dealt out in parts of eight, and the lists beside it go to each part.
        """
        lists = rows.groupBy("cell").agg(F.collect_list(F.struct("id", "x")).alias("rows")).withColumnRenamed("cell", "a")
        parts = sizes.select(F.col("cell").alias("b"), F.ceil(F.col("n") / (8 * BLOCK)).alias("parts"))
        dealt = blocks.join(parts, "b").select("b", "b_x", F.pmod(F.xxhash64("b_low", "b_high"), F.col("parts")).alias("part"))
        asked = near.join(parts, "b").select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        both = lists.join(asked, "a").select("rows", "b", "part").join(dealt, ["b", "part"])
        if labels is not None:
            both = both.join(labels.withColumnRenamed("cell", "b"), "b")
        more = [T.StructField("label", T.LongType())] if labels is not None else []
        schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), *more])
        metric, eps, compared = self.metric, self.eps, self.compared_

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    own = batch.column("rows")[k].values
                    x, y = matrix(own.field("x")), matrix(batch.column("b_x")[k].values)
                    compared.add(len(x) * len(y))
                    n = (distances(x, y, metric) <= eps).sum(1)
                    label = [pa.array(np.full(len(x), batch.column("label")[k].as_py()))] if more else []
                    yield pa.RecordBatch.from_arrays([own.field("id"), pa.array(n), *label], names=schema.names)

        return both.select("rows", "b_x", *(["label"] if more else [])).mapInArrow(run, schema)

    def _groups(self, core: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
        """(node, component) of the core cells; a cell's node is its smallest core row.

        Two cells are first tried by a few rows of each. Only those pairs that this leaves in different components are
        compared in whole, block by block, and only blocks whose boxes come within eps of each other.
        """
        ends = near.join(nodes.select(F.col("cell").alias("a"), F.col("node").alias("na")), "a").join(nodes.select(F.col("cell").alias("b"), F.col("node").alias("nb")), "b").where("na < nb")
        ends = Held(ends.select("a", "b", "na", "nb"), "cell-pairs").df
        own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
        few = core.join(nodes.select("cell", "n"), "cell").where(F.pmod(F.xxhash64("id"), F.col("n")) < TRIED).groupBy("cell").agg(F.slice(F.collect_list("x"), 1, 4 * TRIED).alias("x"))
        pairs = ends.join(few.withColumnRenamed("cell", "a").withColumnRenamed("x", "a_x"), "a").join(few.withColumnRenamed("cell", "b").withColumnRenamed("x", "b_x"), "b")
        found = Held(self._linked(pairs.select("na", "nb", "a_x", "b_x")), "links").df
        first = components(found.select(F.col("na").alias("a"), F.col("nb").alias("b")).union(own))
        side = lambda s: first.select(F.col("node").alias(f"n{s}"), F.col("component").alias(f"c{s}"))
        open_ = ends.join(side("a"), "na").join(side("b"), "nb").where("ca <> cb").select("a", "b", "na", "nb")
        blocks = Held(_blocks(core, "a"), "core-blocks").df
        other = blocks.select(*[F.col(c).alias("b" + c[1:]) for c in blocks.columns])
        apart = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        least = F.sqrt(expr.total(F.transform(apart, lambda v: v * v))) if self.metric == "euclidean" else expr.total(apart)
        whole = open_.join(blocks, "a").join(other, "b").where(least <= self.eps * (1 + SLACK)).select("na", "nb", "a_x", "b_x")
        more = self._linked(whole).select(F.col("na").alias("a"), F.col("nb").alias("b"))
        joined = Held(found.select(F.col("na").alias("a"), F.col("nb").alias("b")).union(more).distinct(), "links").df
        return components(joined.union(own))

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """(na, nb) of the pairs(na, nb, a_x, b_x) in which some two rows are neighbours."""
        schema, metric, eps, compared = T.StructType([pairs.schema["na"], pairs.schema["nb"]]), self.metric, self.eps, self.compared_

        def run(batches):
            for batch in batches:
                keep = []
                for k in range(batch.num_rows):
                    x, y = matrix(batch.column("a_x")[k].values), matrix(batch.column("b_x")[k].values)
                    compared.add(len(x) * len(y))
                    keep.append(bool((distances(x, y, metric) <= eps).any()))
                yield batch.select(["na", "nb"]).filter(pa.array(keep, pa.bool_()))

        return pairs.mapInArrow(run, schema).distinct()

    def fit_predict(self, df: DataFrame, features: str = "features", key: str = "row_id") -> DataFrame:
        return self.fit(df, features, key).labels_
