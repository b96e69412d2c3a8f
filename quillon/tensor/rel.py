"""Tensors as relations: one column per index and a value column `v`; every operation is a join, group or projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c != "v" and c in b.columns]


def combine(a: DataFrame, b: DataFrame, how) -> DataFrame:
    """how(v_a, v_b) over all index columns; an index that one side lacks is broadcast."""
    keys, right = _shared(a, b), b.withColumnRenamed("v", "__w")
    met = a.join(right, keys) if keys else a.crossJoin(right)
    return met.select(*[c for c in dict.fromkeys([*a.columns, *b.columns]) if c != "v"], how(F.col("v"), F.col("__w")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x + y)


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x - y)


def mul(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x * y)


def div(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x / y)


def apply(a: DataFrame, f) -> DataFrame:
    """Elementwise f: Column -> Column."""
    return a.withColumn("v", f(F.col("v")))


def reduce(a: DataFrame, over: list[str], how=F.sum) -> DataFrame:
    """sum, mean or another aggregate over the named indices; also the gradient of broadcasting along them."""
    keep = [c for c in a.columns if c != "v" and c not in over]
    return a.groupBy(*keep).agg(how("v").alias("v")) if keep else a.agg(how("v").alias("v"))


def contract(a: DataFrame, b: DataFrame, over: list[str]) -> DataFrame:
    """Sum over shared indices of the product: matrix multiplication, batched by any other shared index."""
    return reduce(mul(a, b), over)


def transpose(a: DataFrame, names: dict[str, str]) -> DataFrame:
    return a.withColumnsRenamed(names)


def reshape(a: DataFrame, old: dict[str, int], new: dict[str, int]) -> DataFrame:
    """C-order reshape from index sizes old to new."""
    flat, step = F.lit(0).cast("long"), math.prod(old.values())
    for name, size in old.items():
        step //= size
        flat = flat + F.col(name) * step
    held, step, cols = a.select(flat.alias("__flat"), "v"), math.prod(new.values()), []
    for name, size in new.items():
        step //= size
        cols.append(F.expr(f"pmod(__flat div {step}, {size})").alias(name))
    return held.select(*cols, "v")


def gather(a: DataFrame, ids: DataFrame, index: str) -> DataFrame:
    """Rows of a by the integer column `index` of ids: an embedding lookup."""
    return ids.join(a, index).drop(index)


def scatter_add(gradient: DataFrame, ids: DataFrame, on: list[str], index: str) -> DataFrame:
    """The gradient of gather: repeated ids add up."""
    return reduce(gradient.join(ids, on).drop(*on), [])


def _over(along: list[str], a: DataFrame):
    return Window.partitionBy(*[c for c in a.columns if c != "v" and c not in along])


def softmax(a: DataFrame, along: list[str]) -> DataFrame:
    w = _over(along, a)
    raised = a.withColumn("v", F.exp(F.col("v") - F.max("v").over(w)))
    return raised.withColumn("v", F.col("v") / F.sum("v").over(w))


def softmax_backward(y: DataFrame, gradient: DataFrame, along: list[str]) -> DataFrame:
    met = combine(y, gradient, lambda a, g: F.struct(a.alias("y"), g.alias("g")))
    inner = F.sum(F.col("v.y") * F.col("v.g")).over(_over(along, y))
    return met.withColumn("v", F.col("v.y") * (F.col("v.g") - inner))


def log_softmax(a: DataFrame, along: list[str]) -> DataFrame:
    w = _over(along, a)
    top = F.max("v").over(w)
    shifted = a.withColumn("v", F.col("v") - top)
    return shifted.withColumn("v", F.col("v") - F.log(F.sum(F.exp("v")).over(w)))


def normalise(a: DataFrame, along: list[str], eps: float = 1e-5) -> DataFrame:
    """(v - mean) / sqrt(population variance + eps) along indices: layer norm over features, batch norm over rows."""
    w = _over(along, a)
    return a.withColumn("v", (F.col("v") - F.avg("v").over(w)) / F.sqrt(F.var_pop("v").over(w) + eps))


def batch_norm_backward(x_hat: DataFrame, gradient: DataFrame, std: DataFrame, gamma: DataFrame, row: str) -> DataFrame:
    """gamma / std * (g - mean g - x_hat * mean(g x_hat)), means over the rows of the batch."""
    met = combine(x_hat, gradient, lambda x, g: F.struct(x.alias("x"), g.alias("g")))
    w = _over([row], x_hat)
    inner = F.col("v.g") - F.avg(F.col("v.g")).over(w) - F.col("v.x") * F.avg(F.col("v.g") * F.col("v.x")).over(w)
    return mul(div(met.withColumn("v", inner), std), gamma)


def attention(q: DataFrame, k: DataFrame, v: DataFrame, d: int, allowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(output(b, i, e), weights(b, i, j)) from q(b, i, d), k(b, j, d), v(b, j, e).

    Positions that are not allowed get -1e9 added and stay in the sum, so a row with none keeps finite weights.
    """
    scores = contract(q, k, ["d"]).withColumn("v", F.col("v") / math.sqrt(d))
    if allowed is not None:
        scores = scores.withColumn("v", F.col("v") + F.when(allowed, 0.0).otherwise(-1e9))
    weights = softmax(scores, ["j"])
    return contract(weights, v, ["j"]), weights


def causal() -> Column:
    return F.col("j") <= F.col("i")


def positional_table(spark, max_len: int, d_model: int) -> DataFrame:
    """(pos, k, v): sines in even columns, cosines in odd ones, of pos / 10000 ** (2 i / d)."""
    if d_model % 2:
        raise ValueError("d_model must be even")
    grid = spark.range(max_len).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(d_model - 1))).alias("k"))
    angle = F.col("pos") * F.pow(F.lit(10000.0), -2.0 * F.floor(F.col("k") / 2) / d_model)
    return grid.select("pos", "k", F.when(F.col("k") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("v"))


def windows(x: DataFrame, kernel: tuple[int, int], stride: int = 1, padding: int = 0, size: tuple[int, int] | None = None) -> DataFrame:
    """(n, c, oh, ow, kh, kw, h, w, v): each pixel of x(n, c, h, w, v) once for every window that holds it."""
    kh, kw = kernel
    rows = x.withColumn("kh", F.explode(F.sequence(F.lit(0), F.lit(kh - 1)))).withColumn("kw", F.explode(F.sequence(F.lit(0), F.lit(kw - 1))))
    for axis, length in (("h", size[0] if size else None), ("w", size[1] if size else None)):
        top = F.col(axis) + padding - F.col(f"k{axis}")
        limit = (length + 2 * padding - (kh if axis == "h" else kw)) // stride
        rows = rows.withColumn(f"o{axis}", F.expr(f"({axis} + {padding} - k{axis}) div {stride}")).where((top >= 0) & (top % stride == 0) & (F.col(f"o{axis}") <= limit))
    return rows.select("n", "c", "oh", "ow", "kh", "kw", "h", "w", "v")


def conv2d(x: DataFrame, weight: DataFrame, kernel: tuple[int, int], size: tuple[int, int], stride: int = 1, padding: int = 0) -> DataFrame:
    """(n, o, oh, ow, v): cross-correlation with weight(o, c, kh, kw, v). Padding adds nothing, so it has no rows."""
    patches = windows(x, kernel, stride, padding, size).drop("h", "w")
    return contract(patches, weight, ["c", "kh", "kw"])


def max_pool2d(x: DataFrame, kernel: tuple[int, int], size: tuple[int, int], stride: int | None = None, padding: int = 0) -> DataFrame:
    """(n, c, oh, ow, v, h, w) with the place of the first maximum in row order."""
    patches = windows(x, kernel, stride or kernel[0], padding, size)
    best = F.max_by(F.struct("v", "h", "w"), F.struct("v", (-F.col("kh")).alias("a"), (-F.col("kw")).alias("b"))).alias("m")
    return patches.groupBy("n", "c", "oh", "ow").agg(best).select("n", "c", "oh", "ow", "m.v", "m.h", "m.w")


def max_pool2d_backward(pooled: DataFrame, gradient: DataFrame) -> DataFrame:
    """(n, c, h, w, v): each window's gradient goes to its winner; winners of several windows add up."""
    met = pooled.drop("v").join(gradient, ["n", "c", "oh", "ow"])
    return met.groupBy("n", "c", "h", "w").agg(F.sum("v").alias("v"))
