"""Counts of adjacent pairs, a bounded slice of a batch at a time."""

from collections import Counter

import pyarrow as pa

from quillon.operators import tokenizers as Z


def test_slices_are_bounded_and_whole():
    texts = [None, "", "é" * 3, "x" * 50, "ab", "c", None, "漢字", ""]
    for column in (pa.array(texts), pa.array(["no", *texts])[1:]):
        parts = [p.to_pylist() for p in Z.text_slices(column, 6)]
        assert sum(parts, []) == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 6 for p in parts)
    assert list(Z.text_slices(pa.array([], pa.string()), 6)) == []


def test_counts_over_several_slices(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = "abé漢" * (Z.SLICE // 5)
    texts = [long, "x", None, "", "abab", long + "z", "ab"]
    want = Counter(p for t in texts if t for p in zip(t, t[1:]))
    got = Z.adjacent_pairs(spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(1))
    assert {(r["left"], r["right"]): r["n"] for r in got.collect()} == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 1 << 24
