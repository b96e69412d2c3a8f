import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillon.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def classes():
    return np.frombuffer(bpe.class_table(), np.uint8)


def texts():
    rng = random.Random(7)
    alphabet = ["a", "é", "S", "s", "t", "re", "ve", "ll", "'", "'", " ", " ", "\n", "\t", " ", "1", "²", "٣", "!", "?", "漢", "\U0001f600", "́", "\u0085", "\x1c", "​", "d", "m", "\U00010d4a", "\U0002ebf0"]
    out = ["", " ", "  ", "\n", "'s", "''s", " 's", "it's  ok", "x'll've'", "a" * 3000, "ab" * 200 + "!" * 500, " " * 100 + "x", "x" + "\n " * 50]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]


def test_chunks_equal_the_library(library, classes):
    cache = bpe.PieceCache(library._mergeable_ranks, limit=50)
    rows = texts()
    for width in (1, 7, len(rows)):
        for k in range(0, len(rows) if width > 1 else 300, width):
            part = [t.encode() for t in rows[k : k + width]]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            ids, among = bpe.encode_chunk(np.frombuffer(b"".join(part), np.uint8), ends, classes, cache)
            for j, t in enumerate(rows[k : k + width]):
                assert ids[among[j] : among[j + 1]].tolist() == library.encode_ordinary(t), repr(t)


def test_every_code_point_in_context(library, classes):
    cache = bpe.PieceCache(library._mergeable_ranks)
    points = [c for c in range(0, 0x110000, 1) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    rows = [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in points]
    part = [t.encode() for t in rows]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
    ids, among = bpe.encode_chunk(np.frombuffer(b"".join(part), np.uint8), ends, classes, cache)
    want = library.encode_ordinary_batch(rows, num_threads=4)
    assert [ids[a:b].tolist() for a, b in zip(among, among[1:])] == want


def test_scan_is_the_sequential_automaton(classes):
    elements, product, images, _ = bpe._monoid()
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 1000):
        x = elements[rng.integers(0, 16, n)]
        got, state = bpe.prefix_scan(x, product), bpe.BEGIN
        for k in range(n):
            assert images[got[k], bpe.BEGIN] == state
            state = images[x[k], state]


def test_operator_round_trip_with_nulls_repeats_and_clashing_names(spark, library):
    rows = [(k, t, "x", k) for k, t in enumerate(["", None, "it's ok", "it's ok", "é" * 5000, "token ids " * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, extra int")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    for k, t, _, extra in rows:
        want = library.encode_ordinary(t or "")
        assert got[k].ids == want and bytes(got[k].decoded) == (t or "").encode() and got[k].extra == extra
    out = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    assert out[2].ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary("it's ok"))).encode()).hexdigest()
    assert out[1].n_tokens == 0 and out[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_unknown_id_is_an_error(spark):
    df = spark.createDataFrame([([60_000], [1])], "ids array<int>, token_offsets array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(df, PATH).collect()
