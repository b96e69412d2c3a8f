"""DBSCAN on cells against a plain version over all pairs."""

import numpy as np
import pytest

from quillon.operators.density import DBSCAN, components, numbered
from quillon.operators.neighbors import distances


def plain(x, eps, least, metric):
    near = distances(x, x, metric) <= eps
    core = near.sum(1) >= least
    group = np.arange(len(x))
    while True:
        new = np.where(core, np.where(near & core[None], group[None], len(x)).min(1), group)
        if (new == group).all():
            break
        group = new
    number = {g: k for k, g in enumerate(sorted(set(group[core].tolist())))}
    out = []
    for i in range(len(x)):
        seen = [number[group[j]] for j in np.flatnonzero(near[i] & core)]
        out.append(number[group[i]] if core[i] else min(seen, default=-1))
    return out, set(np.flatnonzero(core).tolist())


def run(spark, x, eps, least, metric="euclidean"):
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "row_id long, features array<double>").repartition(4)
    m = DBSCAN(eps, least, metric).fit(df)
    labels = {r["row_id"]: r["label"] for r in m.labels_.collect()}
    core = {r["row_id"] for r in m.core_sample_indices_.collect()}
    return [labels[i] for i in range(len(x))], core, m


@pytest.mark.parametrize("d,eps,least,metric", [(1, 0.05, 3, "euclidean"), (2, 0.3, 4, "euclidean"), (2, 0.4, 5, "manhattan"), (3, 0.5, 6, "euclidean"), (8, 1.6, 5, "euclidean")])
def test_equals_the_plain_version(spark, d, eps, least, metric):
    r = np.random.default_rng(d)
    centres = r.normal(scale=2, size=(5, d))
    x = np.round(np.vstack([centres[r.integers(5, size=300)] + r.normal(scale=0.5, size=(300, d)), r.uniform(-6, 6, size=(60, d)), np.repeat(centres[:1], 20, 0)]), 1)
    labels, core, _ = run(spark, x, eps, least, metric)
    assert (labels, core) == plain(x, eps, least, metric)
    assert -1 in labels and max(labels) >= 1


def test_chains_of_cells_and_touching_boxes(spark):
    x = np.array([[0.5 * i, 0.0] for i in range(40)] + [[0.5 * i, 7.0] for i in range(40)] + [[10.2, 3.0 + 0.45 * i] for i in range(5)])
    labels, core, _ = run(spark, x, 0.5, 2)
    assert (labels, core) == plain(x, 0.5, 2, "euclidean")


def test_a_cell_with_half_of_all_rows_is_not_paired(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.uniform(0, 0.2, size=(1500, 2)), r.uniform(0.75, 0.95, size=(750, 2)), r.uniform(0, 20, size=(750, 2))])
    labels, core, m = run(spark, x, 1.0, 5)
    assert (labels, core) == plain(x, 1.0, 5, "euclidean")
    assert m.compared_.value < 3000 * 3000 / 10


def test_two_full_cells_that_no_row_links(spark):
    r = np.random.default_rng(1)
    x = np.vstack([r.uniform(0, 0.01, size=(400, 2)), r.uniform(1.3, 1.31, size=(400, 2))])
    labels, core, _ = run(spark, x, 1.0, 5)
    assert (labels, core) == plain(x, 1.0, 5, "euclidean") and max(labels) == 1
    x = np.vstack([x, [[0.7, 0.6]]])  # one row links some of the first with some of the second
    labels, core, _ = run(spark, x, 1.0, 5)
    assert (labels, core) == plain(x, 1.0, 5, "euclidean")


def test_components_and_numbers(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 205), (205, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 200, 201: 200, 205: 200}
    values = spark.createDataFrame([(int(v),) for v in np.random.default_rng(3).permutation(500) * 7], "v long").repartition(6)
    assert {r["v"]: r["k"] for r in numbered(values, "k").collect()} == {7 * i: i for i in range(500)}
    assert numbered(values.where("v < 0"), "k").count() == 0
