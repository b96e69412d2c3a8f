"""Training by an index of pairs gives the merges of a plain loop, and touches fewer sequences."""

import random
from collections import Counter

import pytest

from quillon.operators.tokenizers import BPETokenizer, merge_ids, merge_once, replace_pair, settled_merges


def plain(texts, merges):
    seqs, out = [list(t) for t in texts if t], []
    for _ in range(merges):
        counts = Counter(p for s in seqs for p in zip(s, s[1:]))
        if not counts:
            break
        (a, b), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        out.append((a, b, n))
        seqs = [merge_once(s, a, b) for s in seqs]
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé漢") for _ in range(r.randrange(1, 7))) for _ in range(30)]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 12))) for _ in range(n)] + ["aaaaaaa", "aaaa", "ababab", "", "x"]


@pytest.mark.parametrize("seed,merges", [(1, 14), (2, 8)])
def test_merges_and_encoding(spark, seed, merges):
    texts = corpus(seed, 60)
    texts += texts[:20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i long, text string").repartition(3)
    tok = BPETokenizer(merges).fit(df)
    want = plain(texts, merges)
    assert [(*m, n) for m, n in zip(tok.merges_, tok.merge_counts_, strict=True)] == want
    assert sum(tok.sequences_read_) < len(tok.sequences_read_) * len({t for t in texts if t})
    got = {r["i"]: (r["ids"], r["decoded"]) for r in tok.decode(tok.encode(df)).collect()}
    for i, t in enumerate(texts):
        own = list(t)
        for a, b, _ in want:
            own = merge_once(own, a, b)
        assert [tok.vocabulary_[k] for k in got[i][0]] == own and got[i][1] == t
    assert got[999] == ([], "")


def test_merges_until_nothing_is_left(spark):
    for texts in (["ab"], ["aaa"], ["a"], [""], ["abab", "ab"]):
        tok = BPETokenizer(50).fit(spark.createDataFrame([(t,) for t in texts], "text string"))
        assert [(*m, n) for m, n in zip(tok.merges_, tok.merge_counts_, strict=True)] == plain(texts, 50)


def test_merge_ids():
    import numpy as np

    r = random.Random(0)
    for _ in range(300):
        tokens = [r.choice("aab") for _ in range(r.randrange(12))]
        for a, b in (("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")):
            want = [{"a": 0, "b": 1}.get(t, 2) for t in merge_once(tokens, a, b)]
            assert merge_ids(np.array([{"a": 0, "b": 1}[t] for t in tokens], int), "ab".index(a), "ab".index(b), 2).tolist() == want


def test_only_certain_merges_are_taken_together():
    top = [("a", "b", 9), ("c", "d", 8), ("e", "f", 7), ("b", "x", 6), ("g", "h", 5)]
    assert settled_merges(top, set("abcdefghx"), 10, True) == top[:3]
    assert settled_merges(top, set("abcdefghx"), 2, True) == top[:2]
    assert settled_merges([("a", "a", 9), ("c", "d", 8)], set("acd"), 10, True) == [("a", "a", 9)]
    assert settled_merges([("a", "b", 9), ("c", "d", 8), ("x", "b", 8)], set("abcdx"), 10, True) == [("a", "b", 9)]
    assert settled_merges([("a", "b", 9), ("c", "d", 8)], set("abcd"), 10, False) == [("a", "b", 9)]
    assert settled_merges([("a", "b", 9), ("c", "d", 8)], {*"abcd", "ab"}, 10, True) == [("a", "b", 9)]


def test_replace_pair(spark):
    r = random.Random(6)
    rows = [([r.choice(["a", "aa", "b", "é"]) for _ in range(r.randrange(15))], k) for k in range(60)] + [([], 60), (["a"] * 20_000, 61)]
    df = spark.createDataFrame(rows, "ts array<string>, n long").repartition(3)
    for a, b in (("a", "b"), ("a", "a"), ("aa", "a"), ("x", "y")):
        got = {row["n"]: row["ts"] for row in replace_pair(df, a, b).collect()}
        assert got == {n: merge_once(ts, a, b) for ts, n in rows}


def test_training_moves_no_sequences(spark, monkeypatch):
    """Sequences are found by the pairs that lie beside them: training joins nothing."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(4, 30))], "i long, text string")
    monkeypatch.setattr(type(df), "join", lambda *_, **__: pytest.fail("a join"))
    tok = BPETokenizer(4).fit(df)
    assert [(*m, n) for m, n in zip(tok.merges_, tok.merge_counts_, strict=True)] == plain(corpus(4, 30), 4)
