import itertools

import numpy as np
import pytest

from quillon.llm import itq as I


def rows(n=400, d=64, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        if out and rng.random() < 0.5:
            v = np.array(out[rng.integers(len(out))][1]) + rng.normal(size=d) * rng.choice([0, 0.01, 0.02]) / 4
        else:
            v = rng.normal(size=d) / 8
        out.append((k * 3, v.astype(np.float32).tolist(), int(rng.integers(3))))
    return out


def plain(table, threshold=0.98):
    x = {k: np.array(v, float) / np.linalg.norm(v) for k, v, _ in table}
    links = {(a, b) for (a, _, p), (b, _, q) in itertools.combinations(table, 2) if p == q and x[a] @ x[b] >= threshold}
    label = {k: k for k, *_ in table}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return links, {k: root(k) for k in label}


@pytest.mark.parametrize("most", [4096, 3])
def test_links_equal_brute_force_up_to_recall(spark, most):
    table = rows()
    got = {r.vec_id: r for r in I.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int"), most=most).collect()}
    links, component = plain(table)
    found, there = sum(r.n_links for r in got.values()), 2 * len(links)
    assert len(got) == len(table) and there > 200 and 0.97 * there <= found <= there
    degree = {k: sum(k in p for p in links) for k in got}
    assert all(got[k].n_links <= degree[k] for k in got)
    same = sum(got[k].component == component[k] for k in got)
    assert same > 0.97 * len(table)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * side
    q = I.Quantiser.fit(x)
    tables = I.measured_tables(q, x, 0.98, 16)
    assert (I.table_keys(q.codes(x), tables) == I.table_keys(q.codes(y), tables)).any(axis=1).mean() > 0.93
    balance = np.unpackbits(q.codes(x).view(np.uint8)).mean()
    assert 0.45 < balance < 0.55


@pytest.mark.parametrize(("common", "width"), [(1.0, 16), (2.0, 16), (0.0, 24), (1.0, 24)])
def test_recall_with_a_common_direction_and_wider_keys(common, width):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)) + common * rng.normal(size=64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * side
    q = I.Quantiser.fit(x)
    tables = I.measured_tables(q, x, 0.98, width)
    assert tables.shape[1] == width and (I.table_keys(q.codes(x), tables) == I.table_keys(q.codes(y), tables)).any(axis=1).mean() > 0.9


def test_keys_widen_with_the_rows():
    assert [I.key_bits(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 1 << 30, 1 << 40)] == [16, 16, 16, 24, 24, 40]


def test_labels_as_they_are_and_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=64).tolist(), rng.normal(size=12).tolist()
    rows = [(1, a, "x"), (2, a, "y"), (3, a, "x"), (4, b, "x"), (5, [2 * v for v in b], "x"), (6, b, "y")]
    got = {r.vec_id: (r.n_links, r.component) for r in I.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
    df = spark.createDataFrame([(1, a, 1.2), (2, a, 1.9), (3, a, 1.2)], "vec_id long, embedding array<double>, label double")
    assert {r.vec_id: r.n_links for r in I.near_vectors(df).collect()} == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("d", [2, 40, 100])
def test_other_lengths(d):
    x = np.random.default_rng(0).normal(size=(300, d))
    q = I.Quantiser.fit(x)
    assert q.axes.shape == (d, 64) and len(q.codes(x)) == 300


def test_copies_are_counted_and_bad_vectors_stand_alone(spark):
    v = [1.0] + [0.5] * 63
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63, [1.0] * 3]
    table = [(k, v, 1, "x") for k in (9, 4, 7)] + [(2, v, 2, "x"), (1, v, None, "x"), (None, v, 1, "x"), (3, [2 * c for c in v], 1, "x")]
    table += [(100 + k, b, 1, "x") for k, b in enumerate(bad)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in I.digests(df).collect()}
    assert got[9] == (3, 3, False) and got[4] == (3, 3, False) and got[3] == (3, 3, True)
    assert got[2] == (0, 2, True) and got[1] == (0, 1, True) and got[None] == (0, None, True)
    assert all(got[100 + k] == (0, 100 + k, True) for k in range(len(bad)))
    assert I.digests(df.limit(0)).count() == 0
