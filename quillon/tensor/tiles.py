"""Matrices as relations of array tiles: a join brings tiles together, NumPy works inside one, and rows grow with the tiles.

Attention never holds its weights. A tile of queries walks the tiles of keys with a running maximum, sum and output (the
softmax is rescaled when the maximum rises), and tiles above the diagonal are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.held import Held, bounded_batches, forget_shuffles
from quillon.functions.stats import matrix

#: Rows of a tile of queries, of keys, and the side of a matrix tile.
QUERIES, KEYS, SIDE = 1024, 256, 256
SALTS = 16
#: Key rows that are sent to tiles of queries at once: so many times all of them, or LEAST rows.
SENT, LEAST = 2, 100_000


def _tiled(rows: DataFrame, size: int, arrays: list[str]) -> DataFrame:
    """rows(b, i, arrays...) as tiles (b, t, low, high, rows) by i, the least and the greatest i beside them. Indices must differ within b.

    n rows of one b make at most n / size + 1 tiles, each of under twice size rows, however far apart their indices lie:
    cells of size indices are joined in their order. The table of cells has their counts only.
    """
    cell = F.floor(F.col("i") / size)
    counts = rows.groupBy("b", cell.alias("cell")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("cell", cell).join(counts.select("b", "cell", F.floor(before / size).alias("t")), ["b", "cell"])
    return placed.groupBy("b", "t").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.sort_array(F.collect_list(F.struct("i", *arrays))).alias("rows"))


def _rounds(q: DataFrame, k: DataFrame, causal: bool, size: int) -> int:
    """In how many rounds the key rows are sent, so that one round sends at most about SENT times all of them, or LEAST rows."""
    each = lambda rows, a, b: rows.select("b", F.floor(F.col("i") / size).alias("cell"), F.lit(a).alias("a"), F.lit(b).alias("k"))
    cells = each(q, 1, 0).union(each(k, 0, 1)).groupBy("b", "cell").agg(F.sum("a").alias("a"), F.sum("k").alias("k"))
    so_far = Window.partitionBy("b").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum("k").over(so_far if causal else Window.partitionBy("b"))
    cells = cells.select("b", "a", "k", F.floor((F.sum("a").over(so_far) - F.col("a")) / size).alias("t"), seen.alias("seen"))
    tiled = cells.groupBy("b", "t").agg(F.sum("k").alias("k"), F.sum("a").alias("a"), F.max(F.when(F.col("a") > 0, F.col("seen"))).alias("seen"))
    sent, rows = tiled.agg(F.sum(F.when(F.col("a") > 0, F.col("seen"))), F.sum("k")).first()
    return max(1, -(-(sent or 0) // max(LEAST, SENT * (rows or 0))))


def attention(q: DataFrame, k: DataFrame, v: DataFrame, causal: bool = False, queries: int = QUERIES, keys: int = KEYS) -> DataFrame:
    """(b, i, out) from q(b, i, x), k(b, i, x) and v(b, i, x), rows of numbers: softmax(q k' / sqrt(d)) v within each b.

    causal: a query sees keys up to its own index, and one that sees none has no row; so has a query without keys in its b.
    Each tile of queries meets each tile of keys once, so queries * keys products make one row. The tiles of one b are dealt
    out by the queries' tile; key and value rows go to every one of these that may see them. What is sent so grows with the
    square of a b's rows: where it is more than SENT times the keys, the tiles of queries take turns, a round's rows are
    written, and its shuffle files are deleted before the next, so the disk grows with the rows.
    """
    kv = k.select("b", "i", F.col("x").alias("k")).join(v.select("b", "i", F.col("x").alias("v")), ["b", "i"])
    q_tiles = _tiled(q, queries, ["x"]).select("b", "t", "high", F.col("rows").alias("q"))
    k_tiles = _tiled(kv, keys, ["k", "v"]).select("b", F.col("t").alias("s"), "low", F.col("rows").alias("kv"), F.pmod(F.col("t"), F.lit(SALTS)).alias("salt"))
    rounds = _rounds(q, k, causal, queries)
    if rounds == 1:
        return _walked(q_tiles, k_tiles, causal)
    with Held(q_tiles, "queries", "zstd") as own, Held(k_tiles, "keys", "zstd") as others:
        turn = F.pmod(F.xxhash64("b", "t"), F.lit(rounds))
        done = None
        for n in range(rounds):
            forget_shuffles(own.sparkSession)
            part = _walked(own.where(turn == n), others, causal)
            done = Held(part, "attention") if done is None else done.add(part)
        del part
        forget_shuffles(own.sparkSession)
    return done.df


def _walked(q_tiles: DataFrame, k_tiles: DataFrame, causal: bool) -> DataFrame:
    """(b, i, out) of tiles of queries (b, t, high, q) after all tiles of keys (b, s, low, kv, salt) that they see."""
    # the key tiles of one b are spread by a salt, for it may hold most of all rows
    known = q_tiles.select("b", "t", "high").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sees = F.col("low") <= F.col("high") if causal else F.lit(True)
    sent = k_tiles.join(known, ["b", "salt"]).where(sees).drop("salt")
    # A tile of queries goes before the tiles of keys it meets, once: beside each of them it would be most of what is moved.
    first = q_tiles.join(sent.select("b", "t").distinct(), ["b", "t"], "left_semi").select("b", "t", F.lit(None).cast("long").alias("s"), "q", F.lit(None).cast(k_tiles.schema["kv"].dataType).alias("kv"))
    met = first.union(sent.select("b", "t", "s", F.lit(None).cast(q_tiles.schema["q"].dataType), "kv"))
    met = bounded_batches(met.repartition("b", "t").sortWithinPartitions("b", "t", F.asc_nulls_first("s")))
    index = q_tiles.schema["q"].dataType.elementType["i"]
    out = T.StructType([q_tiles.schema["b"], index, T.StructField("out", T.ArrayType(T.DoubleType()))])

    def run(batches):
        now, state = False, None

        def closing():
            b, at, top, total, sums = state
            some = np.flatnonzero(total > 0)
            rows = sums[some] / total[some, None]
            ends = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([b] * len(some), kind_b), at.take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=out.names)

        for batch in batches:
            kind_b = batch.column("b").type
            for n in range(batch.num_rows):
                if batch.column("s")[n].as_py() is None:  # a tile of queries
                    if now:
                        yield closing()
                    own = batch.column("q")[n].values
                    now, x, at = True, matrix(own.field("x")), np.array(own.field("i"))
                    state = [batch.column("b")[n].as_py(), pa.array(at), np.full(len(x), -np.inf), np.zeros(len(x)), None]
                    continue
                other = batch.column("kv")[n].values
                key, value = matrix(other.field("k")), matrix(other.field("v"))
                scores = x @ key.T / math.sqrt(x.shape[1])
                if causal:
                    scores = np.where(np.asarray(other.field("i"))[None] <= at[:, None], scores, -np.inf)
                _, _, top, total, sums = state
                best = np.maximum(top, scores.max(1))
                safe = np.where(np.isfinite(best), best, 0.0)
                keep, raised = np.exp(np.where(np.isfinite(top), top - safe, -np.inf)), np.exp(scores - safe[:, None])
                state[2:] = [best, total * keep + raised.sum(1), (0.0 if sums is None else sums * keep[:, None]) + raised @ value]
        if now:
            yield closing()

    return met.select("b", "s", "q", "kv").mapInArrow(run, out)


def tiles(entries: DataFrame, side: int = SIDE) -> DataFrame:
    """(r, c, tile) of a matrix given by its entries(i, j, v): row r of tiles, column c, and side * side numbers by row; absent entries are 0, repeated ones add up."""
    at = (F.col("i") % side) * side + F.col("j") % side
    cells = entries.groupBy((F.floor(F.col("i") / side)).alias("r"), F.floor(F.col("j") / side).alias("c"), at.alias("at")).agg(F.sum("v").alias("v"))
    lists = cells.groupBy("r", "c").agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v"))
    schema = "r long, c long, tile array<double>"

    def run(batches):
        for batch in batches:
            rows = []
            for n in range(batch.num_rows):
                tile = np.zeros(side * side)
                tile[np.asarray(batch.column("at")[n].values)] = np.asarray(batch.column("v")[n].values)
                rows.append(tile)
            flat = np.concatenate(rows) if rows else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, side * side), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("c"), lists], names=["r", "c", "tile"])

    return lists.mapInArrow(run, schema)


def entries(tiled: DataFrame, side: int = SIDE) -> DataFrame:
    """(i, j, v) of the entries that are not 0."""
    long = tiled.select("r", "c", F.posexplode("tile").alias("at", "v")).where("v <> 0")
    return long.select((F.col("r") * side + F.floor(F.col("at") / side)).alias("i"), (F.col("c") * side + F.col("at") % side).alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame, side: int = SIDE, left: bool = False) -> DataFrame:
    """(r, c, tile) of the product of two tiled matrices, or of a's transpose and b (left).

    Tiles join where a's columns are b's rows; the products of one place are added up as they come, one tile in memory.
    """
    inner, outer = ("r", "c") if left else ("c", "r")
    x = a.select(F.col(inner).alias("k"), F.col(outer).alias("r"), F.col("tile").alias("x"))
    y = b.select(F.col("r").alias("k"), "c", F.col("tile").alias("y"))

    def multiplied(batches):
        yield from _added(batches, lambda batch, n: _square(batch, "x", n, side, left) @ _square(batch, "y", n, side, False))

    def added(batches):
        yield from _added(batches, lambda batch, n: _square(batch, "tile", n, side, False))

    schema = "r long, c long, tile array<double>"
    parts = x.join(y, "k").select("r", "c", "x", "y").sortWithinPartitions("r", "c").mapInArrow(multiplied, schema)  # one tile a task and place
    return parts.repartition("r", "c").sortWithinPartitions("r", "c").mapInArrow(added, schema)


def _square(batch, name, n, side, turn):
    tile = np.asarray(batch.column(name)[n].values).reshape(side, side)
    return tile.T if turn else tile


def _added(batches, tile_of):
    """Sums of the tiles of equal (r, c), which come one after the other."""
    now, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["r", "c", "tile"])

    for batch in batches:
        for n in range(batch.num_rows):
            place = batch.column("r")[n].as_py(), batch.column("c")[n].as_py()
            if place != now:
                if now is not None:
                    yield out()
                now, total = place, 0.0
            total = total + tile_of(batch, n)
    if now is not None:
        yield out()
