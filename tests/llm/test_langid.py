import math
import random
import zlib
from collections import Counter

import numpy as np

from quillon.llm import langid as L

WORDS = {"en": "the and of with from this that over under river stone".split(), "de": "und der die das über straße nicht schön wald fluß".split(), "fr": "le la été garçon où français eau forêt rivière pierre".split()}


def corpus(n=300):
    rng = random.Random(1)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang) for k, lang in ((k, rng.choice(sorted(WORDS))) for k in range(n))]


def plain_buckets(text):
    """The n-grams of one text, one character at a time."""
    chars = []
    for c in text:
        if c.isalpha():
            chars.append(ord(c.lower()[0]))
        elif chars and chars[-1] != 32:
            chars.append(32)
    out = []
    for at in range(len(chars)):
        h = 0
        for n in range(1, 4):
            if at + n > len(chars):
                break
            h = ((h ^ chars[at + n - 1]) * 0x9E3779B1 + n) & 0xFFFFFFFF
            h ^= h >> 15
            out.append(((h * 0x85EBCA77) & 0xFFFFFFFF) >> 16)
    return out


def test_scores_equal_a_plain_naive_bayes(spark):
    rows = corpus()
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = {lang: Counter() for lang in WORDS}
    for _, t, lang in rows:
        seen[lang].update(plain_buckets(t))
    texts = ["the river", "straße, und WALD!", "", None, "12 %%", "été\n\nforêt", "x"]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in L.predict(df, model).collect()}
    for k, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        joint = {lang: math.log(sum(r[2] == lang for r in rows) / len(rows)) + sum(math.log((c[b] + 0.1) / (c.total() + 0.1 * L.BUCKETS)) for b in plain_buckets(t)) for lang, c in seen.items()}
        top = max(joint, key=joint.get)
        assert got[k].lang_pred == top
        assert abs(got[k].score - 1 / sum(math.exp(x - joint[top]) for x in joint.values())) < 1e-9


def test_batches_do_not_matter():
    texts = [t.encode() for _, t, _ in corpus(50)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = L.LanguageModel(("a", "b"), np.zeros(2), np.random.default_rng(0).normal(size=(2, L.BUCKETS + 1)) * (np.arange(L.BUCKETS + 1) < L.BUCKETS))
    together = L.scores(np.frombuffer(b"".join(texts), np.uint8), ends, model)
    for k, t in enumerate(texts):
        one = L.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]), model)
        assert one[0][0] == together[0][k] and abs(one[1][0] - together[1][k]) < 1e-9


def test_held_out_fold_and_accuracy(spark):
    rows = [(*r, "src") for r in corpus(600)] + [(1000, "und", None, None), (None, "the river", "en", "x")]
    got = L.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identified(df).collect()] == [("und", 0.0)]
    assert L.identified(df.limit(0)).count() == 0
