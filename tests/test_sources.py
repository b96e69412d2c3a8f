"""Draws by counter, IDX files by ranges, and labels by a dictionary table."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import streams
from quillon.operators.cluster import GaussianMixture
from quillon.operators.preprocessing import SparseOneHotEncoder
from quillon.sources import generators, idx


@pytest.mark.parametrize("make", [generators.large_blobs, generators.large_regression, generators.large_moons])
def test_rows_do_not_depend_on_partitions(spark, make):
    def mark(parts):
        df = make(spark, 200_000, seed=5, partitions=parts, **({} if make is generators.large_blobs else {"noise": 0.3}))
        assert df.rdd.getNumPartitions() == parts
        return df.agg(F.sum(F.xxhash64("row_id", "features", "y").cast("decimal(38,0)")), F.count("*")).first()

    assert mark(2) == mark(60)


def test_draws_have_their_distribution(spark):
    z = np.array([r["z"] for r in spark.range(20_000).select(F.concat(streams.normals(F.col("id"), 1, 2), F.array(streams.uniform(F.col("id"), 1, 9))).alias("z")).collect()])
    assert np.allclose(z.mean(0), [0, 0, 0.5], atol=0.03) and np.allclose(z.var(0), [1, 1, 1 / 12], atol=0.03)
    assert abs(np.corrcoef(z.T)[0, 1]) < 0.03 and 0 < z[:, 2].min() and z[:, 2].max() < 1


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_samples_of_a_mixture(spark, kind):
    m = GaussianMixture(2, kind, random_state=4)
    cov = np.array([[2.0, 0.6], [0.6, 1.0]])
    m.weights_, m.means_ = np.array([0.25, 0.75]), np.array([[0.0, 0.0], [10.0, -10.0]])
    m.covariances_ = {"full": np.array([cov, cov]), "tied": cov, "diag": np.array([[2.0, 1.0]] * 2), "spherical": np.array([2.0, 1.0])}[kind]
    rows = m.sample(spark, 8000, 5).orderBy("row_id").collect()
    assert rows == m.sample(spark, 8000, 2).orderBy("row_id").collect() and [r["row_id"] for r in rows] == list(range(8000))
    c, x = np.array([r["component"] for r in rows]), np.array([r["features"] for r in rows])
    assert (np.diff(c) >= 0).all() and abs((c == 0).mean() - 0.25) < 0.02
    assert np.allclose(x[c == 1].mean(0), [10, -10], atol=0.1)
    want = {"full": cov, "tied": cov, "diag": np.diag([2.0, 1.0]), "spherical": np.eye(2)}[kind]
    assert np.allclose(np.cov(x[c == 1].T), want, atol=0.15)


def test_idx_files(spark, tmp_path):
    r = np.random.default_rng(0)
    x, y = r.integers(256, size=(1000, 4, 3), dtype=np.uint8), r.integers(10, size=1000, dtype=np.uint8)
    (tmp_path / "x").write_bytes(struct.pack(">IIII", 0x803, 1000, 4, 3) + x.tobytes())
    (tmp_path / "y").write_bytes(struct.pack(">II", 0x801, 1000) + y.tobytes())
    (tmp_path / "f").write_bytes(bytes([0, 0, 0x0D, 2]) + struct.pack(">II", 2, 2) + np.array([[1.5, 2], [3, -4]], ">f4").tobytes())
    idx.register(spark)
    df = spark.read.format("idx").option("rangeBytes", "1200").load(str(tmp_path / "x"))
    assert df.rdd.getNumPartitions() == 10
    got = {row["row_id"]: row["v"] for row in df.collect()}
    assert got == {i: x[i].ravel().tolist() for i in range(1000)}
    both = {row["row_id"]: (row["features"], row["y"]) for row in idx.load_labelled(spark, str(tmp_path / "x"), "file://" + str(tmp_path / "y")).collect()}
    assert all(both[i][1] == y[i] and np.allclose(both[i][0], x[i].ravel() / 255) for i in range(1000))
    assert sorted(row["v"] for row in spark.read.format("idx").load(str(tmp_path / "f")).collect()) == [[1.5, 2.0], [3.0, -4.0]]
    assert spark.read.format("idx").load(str(tmp_path)).groupBy("file").count().count() == 3


def test_broken_idx_files_are_refused(spark, tmp_path):
    idx.register(spark)
    for name, raw, said in (("magic", b"\1\0\x08\1" + bytes(8), "not an IDX file"), ("kind", b"\0\0\x07\1" + bytes(8), "not an IDX file"), ("short", struct.pack(">II", 0x801, 9) + bytes(3), "ends early"), ("none", b"", "not an IDX file")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=said):
            spark.read.format("idx").load(str(tmp_path / name)).collect()
    (tmp_path / "empty").write_bytes(struct.pack(">II", 0x801, 0))
    assert spark.read.format("idx").load(str(tmp_path / "empty")).count() == 0


def test_sparse_one_hot(spark):
    df = spark.range(60_000).select("id", F.concat(F.lit("c"), F.pmod(F.col("id") * 7919, F.lit(20_000))).alias("label"), F.lit(1).alias("index"))
    enc = SparseOneHotEncoder().fit(df, "label")
    assert enc.n_categories_ == 20_000
    out = enc.transform(df, "label")
    assert out.columns == ["id", "label", "index", "one_hot"]
    back = enc.inverse_transform(out, into="again")
    assert back.where("again <> label or again is null").count() == 0
    ranks = {l: k for k, l in enumerate(sorted(f"c{i}" for i in range(20_000)))}
    assert all(r["one_hot"] == (20_000, [ranks[r["label"]]], [1.0]) for r in out.limit(200).collect())
    for bad in ("zzz", None):
        with pytest.raises(Exception, match="unseen category"):
            enc.transform(spark.createDataFrame([(1, bad)], "id long, label string"), "label").collect()
    with pytest.raises(Exception, match="out of range"):
        enc.inverse_transform(spark.sql("SELECT struct(20000L AS size, array(20000L) AS indices, array(1D) AS values) AS one_hot")).collect()
    with pytest.raises(ValueError, match="no rows"):
        SparseOneHotEncoder().fit(df.where("id < 0"), "label")
    enc.close()
