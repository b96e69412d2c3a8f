"""Running statistics by key, and the same ones after a restart from the checkpoint."""

import numpy as np
import pytest

from quillon.streaming import keyed


@pytest.fixture
def parts(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    r = np.random.default_rng(0)
    rows = [(["a", "b", "c", None][int(r.integers(4))], float(v) if v > -1 else None) for v in r.normal(5, 3, 600)]

    def add(lo, hi):
        spark.createDataFrame(rows[lo:hi], "k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    yield rows, add, tmp_path
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == old


def expected(rows):
    out = {}
    for k in {k for k, _ in rows}:
        v = np.array([x for own, x in rows if own == k and x is not None])
        out[k] = (len(v), v.mean(), v.var())
    return out


def check(spark, folder, rows):
    got = {r["key"]: (r["n"], r["mean"], r["variance"]) for r in keyed.latest(spark, f"{folder}/out").collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:]) for k in want)


def test_state_survives_a_restart(spark, parts):
    rows, add, folder = parts
    source = lambda: spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    run = lambda: keyed.run_available(keyed.running_statistics(source(), "k", "v"), f"{folder}/out", f"{folder}/checkpoint")
    for lo in (0, 100):
        add(lo, lo + 100)
    run()
    check(spark, folder, rows[:200])
    add(200, 600)
    run()  # another query, which knows the earlier rows by its state alone
    check(spark, folder, rows)
    assert spark.read.parquet(f"{folder}/out").select("epoch").distinct().count() == 3
