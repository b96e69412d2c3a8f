"""Tiled attention and products against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.tensor import tiles


def plain(q, k, v, causal, at=None):
    s = q @ k.T / np.sqrt(q.shape[1])
    if causal:
        s = np.where(at[None] <= at[:, None], s, -np.inf)
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True) @ v


@pytest.mark.parametrize("causal", [False, True])
def test_attention(spark, causal):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for b, n in (("hot", 150), ("one", 1), ("few", 9)):
        at = np.sort(r.choice(400, n, replace=False))
        q, k, v = (r.normal(size=(n, 5)) * 30 for _ in range(3))  # large scores: the maximum must be taken out
        v = v[:, :3]
        rows += [(b, int(i), *(x.tolist() for x in z)) for i, z in zip(at, zip(q, k, v), strict=True)]
        want |= {(b, int(i)): o for i, o in zip(at, plain(q, k, v, causal, at), strict=True)}
    df = spark.createDataFrame(rows, "b string, i long, q array<double>, k array<double>, v array<double>").repartition(5)
    part = lambda c: df.select("b", "i", F.col(c).alias("x"))
    for sizes in ({}, {"queries": 32, "keys": 8}):
        got = {(r["b"], r["i"]): r["out"] for r in tiles.attention(part("q"), part("k"), part("v"), causal, **sizes).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[x], want[x]) for x in want)


def test_tiles_above_the_diagonal_are_left_out(spark):
    x = spark.range(64).select(F.lit(0).alias("b"), F.col("id").alias("i"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    alone = x.where("i < 8")
    got = tiles.attention(x, alone.withColumn("i", F.col("i") + 40), alone.withColumn("i", F.col("i") + 40), True, 16, 4)
    assert sorted(r["i"] for r in got.collect()) == list(range(40, 64))  # earlier queries see no key
    assert tiles.attention(x.where("i < 0"), x, x).count() == 0


@pytest.mark.parametrize("left", [False, True])
def test_matmul(spark, left):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(11, 23)), r.normal(size=(11 if left else 23, 7))
    a[r.random(a.shape) < 0.5] = 0
    make = lambda m: tiles.tiles(spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.argwhere(m).tolist()], "i long, j long, v double").repartition(3), 4)
    got = np.zeros((23 if left else 11, 7))
    for x in tiles.entries(tiles.matmul(make(a), make(b), 4, left), 4).collect():
        got[x["i"], x["j"]] = x["v"]
    assert np.allclose(got, (a.T if left else a) @ b)


def test_tasks_hold_few_tiles_at_once(spark):
    """A tile of queries is moved once and not beside each tile of keys, and Python gets a bounded number of bytes."""
    x = spark.range(300).select(F.lit(0).alias("b"), F.col("id").alias("i"), F.array_repeat(F.col("id").cast("double"), 8).alias("x"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plan = tiles.attention(x, x, x, True, 128, 16)._jdf.queryExecution().optimizedPlan()
    below = plan.toString().split("MapInArrow")[1]
    assert "Union" in below[: below.index("Join")]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 1 << 24


def test_keys_are_sent_in_rounds(spark):
    """131,000 key rows would be sent at once for 1,024; they go in rounds, whose joins are done when the rows are read."""
    r = np.random.default_rng(5)
    q = r.normal(size=(1024, 3))
    x = spark.createDataFrame([(0, i, a.tolist()) for i, a in enumerate(q)], "b int, i long, x array<double>").repartition(3)
    out = tiles.attention(x, x, x, True, 4, 4)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["i"]: r["out"] for r in out.collect()}
    want = plain(q, q, q, True, np.arange(1024))
    assert len(got) == out.count() == 1024 and all(np.allclose(got[i], want[i]) for i in got)


def test_tiles_are_full_where_indices_lie_apart(spark):
    """Every tenth index is there, and a clump: tiles hold their number of rows all the same, in the order of the index."""
    at = [*range(0, 4000, 10), *range(4000, 4100), 9999]
    rows = spark.createDataFrame([(0, i, [float(i)]) for i in at], "b int, i long, x array<double>").repartition(4)
    got = sorted((r["low"], r["high"], [x["i"] for x in r["rows"]]) for r in tiles._tiled(rows, 50, ["x"]).collect())
    assert [i for _, _, own in got for i in own] == at
    assert all(low == own[0] and high == own[-1] and len(own) < 100 for low, high, own in got) and len(got) <= len(at) / 50 + 1
