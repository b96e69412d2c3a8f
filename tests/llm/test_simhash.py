import itertools
import random

import pytest
import xxhash

from quillon.llm import simhash as S


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[a : a + k]) for a in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius):
    label = {x: x for x in {r[1] for r in rows}}
    fps = sorted(label)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            label[root(a)] = root(b)
    least = {}
    for key, fp in rows:
        if key is not None:
            least[root(fp)] = min(key, least.get(root(fp), key))
    return {(key, fp): least.get(root(fp)) for key, fp in rows}


def test_masks_cover_every_choice_of_bits():
    masks = S.covering_masks(4)
    assert len(masks) == 31 and len(set(masks)) == 31
    rng = random.Random(0)
    for _ in range(20_000):
        flipped = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & flipped == 0 for m in masks)
    for flipped in itertools.combinations(range(12), 4):
        assert any(m & sum(1 << b for b in flipped) == 0 for m in masks)


def texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = ["", None, " \t\n", "One", "one", "one two three", "ONE  two\tthree", "é É x y", "  x y z"]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    return rows


@pytest.mark.parametrize("most", [4096, 3])
def test_components_equal_brute_force(spark, most):
    rows = [(k if k != 17 else None, t, 1) for k, t in enumerate(texts())]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int"), most=most).collect()
    fps = [(k, plain_fingerprint(t)) for k, t, _ in rows]
    want = plain_components(fps, 4)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component) for r in got), key=str) == sorted(((k, f, want[k, f]) for k, f in fps), key=str)


@pytest.mark.parametrize("most", [4096, 40, 5])
def test_a_large_ball_of_fingerprints(spark, most):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in S.near_links(df, 4, most).collect():
        a, b = r.a % 2**64, r.b % 2**64
        label[root(a)] = root(b)
    mine, want = {}, plain_components([(f, f) for f in fps], 4)
    for f in fps:
        mine.setdefault(root(f), []).append(f)
    assert {min(v): sorted(v) for v in mine.values()} == {c: sorted(f for f in fps if want[f, f] == c) for c in set(want.values())}


def test_empty_table(spark):
    assert S.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digest_columns(spark):
    got = S.digests(spark.createDataFrame([(5, "a b c d e", 1), (3, "a b c d e", 2), (9, None, 3)], "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(3, f"{plain_fingerprint('a b c d e'):016x}", 3), (5, f"{plain_fingerprint('a b c d e'):016x}", 3), (9, "0" * 16, 9)]


def test_similar_documents_are_candidates_by_their_simhash(spark, monkeypatch):
    """Without any MinHash band, sets whose fingerprints lie within the radius still meet, and the texts decide."""
    monkeypatch.setattr(S, "BANDS", 0)
    rng = random.Random(6)
    rows = []
    for k in range(6):
        base = [f"w{rng.randrange(99999)}" for _ in range(3000)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:1500] + ["new"] + base[1501:]))]
    df = spark.createDataFrame([*rows, (20, ""), (21, None)], "doc_id long, text string")
    fps = {r.doc_id: r.fp for r in S.sketches(df).collect()}
    near = [k for k in range(6) if ((fps[2 * k] ^ fps[2 * k + 1]) & (2**64 - 1)).bit_count() <= 4]
    assert len(near) >= 3
    got = {r.doc_id: r.component for r in S.similar_documents(df).collect()}
    assert len(got) == 14 and got[21] == 20 and all(got[2 * k + 1] == 2 * k for k in near)
