"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import drop, written


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Each half-step is one partial aggregate (min per node, combined before the shuffle) and one equi-join against its
    result, whose right side has one row per node, so a hub with a third of all edges can be split by AQE. Every
    round's edges are written to the shared folder; no list of neighbours is ever gathered. Null ends are ignored,
    self loops give a node its own component.
    """
    pairs = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, "components")
    loops = pairs.where("u = v").select(F.col("u").alias("node"))
    now = pairs.where("u > v")
    nodes = now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).union(loops).distinct()
    before = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, written(small, "components")
        if hasattr(last, "scratch_path"):
            drop(last.sparkSession, last.scratch_path)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
