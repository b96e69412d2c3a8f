"""Winnowing against a plain version, and its guarantee."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import winnow


def plain(text, k=winnow.K, window=winnow.WINDOW):
    """(hash, position) of the prints, window by window."""
    codes = [(xxhash.xxh64_intdigest(w.encode(), 42) & (winnow.PRIME - 1)) + 1 for w in re.findall(winnow.WORD, text)]
    if not codes:
        return []
    codes += [0] * (k - len(codes))
    grams = [sum(c * pow(winnow.BASE, k - 1 - j, winnow.PRIME) for j, c in enumerate(codes[i : i + k])) % winnow.PRIME for i in range(len(codes) - k + 1)]
    kept = []
    for i in range(max(1, len(grams) - window + 1)):
        best = min(range(i, min(i + window, len(grams))), key=lambda j: (grams[j], -j))
        if not kept or kept[-1][1] != best:
            kept.append((grams[best], best))
    return kept


def shown(prints):
    return " ".join(f"{(h << 32) + p:x}" for h, p in prints)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for at, (i, t) in enumerate(rows):
        follow = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        a, b, c = plain(t), plain(edited), plain(follow)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c)))
    return out


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = ["ä", "be", "ccc", "漢字", "😀x", "the", "of", "x" * 70]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 8, 9, 30, 200]))) for _ in range(n)]


def test_equals_the_plain_version(spark):
    rows = [(7 * i - 50, t) for i, t in enumerate(texts(1, 400))]
    rows += [(10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, "a b c d e"), (10_004, "a b c d e"), (10_005, "same " * 50), (10_006, " ".join(str(i % 977) for i in range(5000))), (None, "no id of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = got(winnow.digests(df))
    assert out == sorted(expected(rows), key=str)
    prints = {r[0]: r[3] for r in out}
    assert prints[10_003] == prints[10_004] and prints[10_003].count(" ") == 0 and prints[10_001] == ""


@pytest.mark.parametrize("k,window", [(1, 1), (2, 3), (3, 7), (7, 6), (8, 8)])
def test_any_k_and_window(spark, k, window):
    own = texts(k, 60) + [" ".join(str(i * i % 31) for i in range(2500))]
    df = spark.createDataFrame(list(enumerate(own)), "i int, t string")
    for r in df.select("i", winnow.positions(winnow.winnow(F.col("t"), k, window)).alias("p")).collect():
        assert [tuple(x) for x in r["p"]] == plain(own[r["i"]], k, window)


def test_shared_passages_share_a_print(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    pairs = []
    for i in range(100):
        passage = " ".join(word() for _ in range(winnow.K + winnow.WINDOW - 1))
        a, b = ([word() for _ in range(r.randrange(40))] for _ in range(2))
        pairs.append((i, " ".join([*a, passage, word()]), " ".join([word(), passage, *b])))
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    shared = F.size(F.array_intersect(winnow.hashes(winnow.winnow(F.col("a"))), winnow.hashes(winnow.winnow(F.col("b")))))
    assert df.where(shared == 0).count() == 0


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(winnow.digests(none)) == []
    one = [(3, "a b c d e f g h")]
    assert got(winnow.digests(spark.createDataFrame(one, "doc_id int, text string"))) == expected(one)
    more = spark.createDataFrame([(i, f"t {i}", "x", 1, 2) for i in range(300)], "doc_id long, text string, prints string, bucket int, copy int")
    assert len(got(winnow.digests(more))) == 300
    follow = {r["doc_id"]: r["next_"] for r in winnow.with_next(more, next_="doc_id").collect()}
    assert follow == {i: (i + 1) % 300 for i in range(300)}
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None), (None, "z")], "doc_id long, text string")
    assert len(got(winnow.digests(twice))) == 5
