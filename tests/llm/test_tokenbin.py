import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import storage
from quillon.llm import tokenbin as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    bits = ["a", "É", "straße", "İ", "ΟΔΟΣ", "é", "́x", "don't", "'s", "42", "½", "!", "...", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "​", "漢字", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "ﬁ", "Å", "가", "한"]
    return ["", " ", "\n", "x" * 4000, "<|endoftext|>hi", "a<|endoftext|> b"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_words_equal_whole_texts(library):
    words = B.WordIds(open(PATH, "rb").read(), limit=500)
    rows = texts()
    for at in range(0, len(rows), 40):
        ids, n = words.encode(rows[at : at + 40])
        for t, stop, k in zip(rows[at : at + 40], np.cumsum(n), n):
            assert ids[stop - k : stop].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_is_minimal_and_refuses_strangers(n):
    keys = np.random.default_rng(n).choice(np.arange(-(2**40), 2**40, 7_000_003 if n < 100_000 else 7), n, replace=False).astype(np.int64)
    h = B.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))
    again, _ = B.PerfectHash.load(h.dump())
    assert np.array_equal(again.slots(keys), h.slots(keys))
    index = B.Index(B.index_bytes(keys, np.arange(n) % 7, np.arange(n), np.ones(n)))
    which, runs = index.find(keys)
    assert which.tolist() == list(range(n)) and runs[:, 1].tolist() == list(range(n)) and (runs[:, 2] == 1).all()
    strange, _ = index.find(np.arange(2**41, 2**41 + 2000))
    assert len(strange) <= 1


def test_a_key_may_go_on_in_later_shards():
    index = B.Index(B.index_bytes(np.array([4, 9, 4, 4]), np.array([3, 3, 5, 4]), np.array([7, 8, 0, 0]), np.array([2, 1, 6, 99])))
    which, runs = index.find(np.array([9, 5, 4]))
    assert sorted(zip(which.tolist(), map(tuple, runs.tolist()))) == [(0, (3, 8, 1)), (2, (3, 7, 2)), (2, (4, 0, 99)), (2, (5, 0, 6))]


def test_equal_keys_are_an_error_for_the_hash():
    with pytest.raises(ValueError, match="distinct"):
        B.PerfectHash.build(np.array([5, 5]))


def test_digests_equal_the_library(spark, library):
    rows = [(k * 3 - 50, t, "clash", 1) for k, t in enumerate(texts()[:300])] + [(4_000_000_000, None, "x", 1), (7, "twice", "", 1), (7, "again", "", 1), (7, "again", "", 1), (None, "no key", "", 1), (None, None, "", 1)]
    got = B.digests(spark.createDataFrame(rows, "doc_id long, text string, key string, start int").repartition(5), PATH, partitions=4).collect()
    want, start = [], 0
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, '<u4').tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_shards_repeated_keys_and_a_vocabulary_without_end(spark, library):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC,.'é") for _ in range(rng.randint(1, 12)))
    rows = [(rng.choice([1, 2, 3, None, k]), " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = storage.scratch(spark, "tokens")
    manifest = B.write_shards(df, folder, PATH, partitions=3, shard_bytes=2000)
    assert manifest.select("shard").distinct().count() > 10
    parts = B.write_index(manifest, folder, part_keys=50)
    places = B.locate(manifest.select("key").distinct(), folder, parts).unionByName(manifest.where("key is null").select("key", "shard", "row"))
    found = B.read_rows(places, manifest.select("shard", "file").distinct(), folder).orderBy("shard", "row").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r.key for r in found] == [k for k, _ in want]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [[*library.encode(t, add_special_tokens=False).ids, 2] for _, t in want]


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 0, "c": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    raw = other.to_str().encode()
    assert B.splits_at_blanks(open(PATH, "rb").read()) and not B.splits_at_blanks(raw)
    ids, n = B.WordIds(raw).encode(["a b,c", "", "a b"])
    assert ids.tolist() == [0, 1, 0] and n.tolist() == [2, 0, 1]


def test_keyed_access(spark, library):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    folder = storage.scratch(spark, "tokens")
    manifest = B.write_shards(df, folder, PATH, partitions=3)
    parts = B.write_index(manifest, folder, part_keys=30)
    assert parts == 4
    asked = spark.createDataFrame([(5,), (99,), (1000,), (None,)], "key long")
    found = B.read_rows(B.locate(asked, folder, parts), manifest.select("shard", "file").distinct(), folder).collect()
    assert {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in found} == {k: [*library.encode(f"text {k}", add_special_tokens=False).ids, 2] for k in (5, 99)}


def test_empty_table(spark):
    df = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert B.digests(df.limit(0), PATH).count() == 0
    assert [(r.doc_id, r.start) for r in B.digests(df, PATH).collect()] == [(None, 0)]


def test_latin_words_are_plain_and_known_from_task_to_task():
    """Words of Latin letters get the library's ids without the library's whole path, and one process keeps them."""
    raw = open(PATH, "rb").read()
    words = B._words(raw)
    assert B._words(bytes(raw)) is words
    library = words.tokenizer
    texts = ["Ça où ÉTÉ, straße's l'été\n\nÀ  Þ", "", "x²½ ªº µm ÷ × İ ſ naïve", "été ÿ'S 'Ré's"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    words.tokenizer = None  # met for words that are not plain only
    ids, n = words.encode(texts[:2])
    assert ids.tolist() == want[0] and n.tolist() == [len(want[0]), 0]
    words.tokenizer = library
    ids, n = words.encode(texts)
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
