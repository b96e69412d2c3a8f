import itertools
import random
import re

import pytest

from quillon.llm import decontam as D


def plain(documents, items):
    """(doc, item) -> (agreeing words, window) by trying all alignments."""
    out = {}
    for key, text in sorted(items, key=lambda x: x[0]):
        b = re.findall(r"[^\W_]+", text.lower())
        if not b:
            continue
        n = min(len(b), D.WINDOW)
        for doc, body in documents:
            a = re.findall(r"[^\W_]+", (body or "").lower())
            best = max((sum(x == y for x, y in zip(a[i : i + n], b[j : j + n])) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1)), default=0)
            if best >= n - D.allowed(n):
                out[doc, key] = (best, n)
    return out


@pytest.mark.parametrize("n", [1, 4, 7, 8, 9, 10, 14, 15, 19, 20, 27])
def test_masks_are_complete(n):
    window = min(n, D.WINDOW)
    for spoiled in itertools.combinations(range(window), D.allowed(window)):
        assert any(not {at + off for off in mask} & set(spoiled) for mask in D.masks_for(n) for at in range(window - mask[-1]))


def fixture():
    rng = random.Random(2)
    words = [f"v{k}" for k in range(40)] + ["the", "Of", "and"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(pick(rng.choice([3, 8, 9, 12, 19, 20, 30, 45])))) for k in range(25)]
    items.append((99, items[5][1].upper()))
    documents = [(0, None), (1, ""), (2, items[24][1]), (3, "x, " + items[3][1] + "! y")]
    for k in range(4, 120):
        body = pick(rng.choice([5, 30, 80]))
        if k % 2:
            b = rng.choice(items)[1].split()
            a = rng.randrange(0, max(1, len(b) - 15))
            b = b[a : a + rng.choice([15, 20, 25, 50])]
            for _ in range(rng.choice([0, 1, 3, 4, 5])):
                b[rng.randrange(len(b))] = "zzz"
            at = rng.randrange(len(body))
            body[at:at] = b
        documents.append((k, " ".join(body)))
    return documents, items


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_equals_brute_force(spark, block_words):
    documents, items = fixture()
    docs = spark.createDataFrame([(*d, 7) for d in documents], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (100, None), (101, "!!")], "item_id long, text string")
    got = D.leaks(docs, bench, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id): (r.matched, r.window) for r in got} == plain(documents, items) and len(got) > 20
    texts = dict(documents)
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    assert all(texts[r.doc_id][r.start : r.stop] == r.passage for r in got)


def test_repeated_rows_and_empty_tables(spark):
    documents, items = fixture()
    docs, bench = spark.createDataFrame([documents[3]] * 2, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.leaks(docs, bench).count() == 2
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0


def test_item_ids_of_any_type_null_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "say a b c d e f g h i j now"), (2, "tiny, thing here"), (3, "thing tiny")], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "a b c d e f g h i j"), ("y", "A B c d e f g h i j"), (None, "a b c d e f g h i j"), ("z", "Tiny thing")], "item_id string, text string")
    got = D.leaks(docs, bench).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in got) == [(1, "None"), (1, "x"), (1, "y"), (2, "z")]
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [3]
    with pytest.raises(ValueError, match="names of their own"):
        D.leaks(docs, bench.withColumnRenamed("item_id", "doc_id"), item="doc_id")


def test_a_preamble_of_thousands_of_items_stays_in_bounds(monkeypatch):
    """Hits are looked at so many meetings at a time, and a very long document gives the same as its parts."""
    import numpy as np

    rng = np.random.default_rng(0)
    preamble = rng.integers(0, 2**63, 12).astype(np.uint64)
    words = [np.concatenate([preamble, rng.integers(0, 2**63, 12).astype(np.uint64)]) for _ in range(1500)]
    index = D.SeedIndex.build([b"%d" % k for k in range(1500)], words)
    body = np.concatenate([preamble] * 60 + [words[7]])
    largest = []
    verify = D.SeedIndex._verify
    monkeypatch.setattr(D.SeedIndex, "_verify", lambda self, found, *rest: (largest.append(len(found)), verify(self, found, *rest))[1])
    got = index.search(body, np.array([0, len(body)]))
    assert [x[1] for x in got if x[2] == 20] == [7] and max(largest) <= 4096
