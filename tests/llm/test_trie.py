"""The prefix trie against a plain version over lists of turns."""

import hashlib
import random
import zlib

import duckdb

from quillon.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    original = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        original.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = original.get(base, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for node, own in members.items():
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), *sums[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    out = trie.conversation_trie(df)
    assert out.columns == NAMES and all(t == "bigint" for n, t in out.dtypes if n != "ends_sha256")
    return sorted(map(tuple, out.collect()), key=str)


def sample(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 20 * convs), convs):
        for t in range(r.randrange(1, longest)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["", "ok", "ä", "yes", None])))
    return rows


KIND = "conv_id long, turn long, role string, text string"


def test_equals_the_plain_version(spark):
    rows = sample(1, 200, 14)
    rows += [(10_000 + i, t, "user", f"copy {t}") for i in range(60) for t in range(12)]  # many copies
    rows += [(7, t, "user", str(t % 3)) for t in range(3000)] + [(8, t, "user", str(t % 3)) for t in range(2500)]  # long, and sharing a start
    rows += [(None, 1, "user", "nobody's"), (20_001, 0, "us", "er:x"), (20_002, 0, "user", ":x")]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    want = plain(rows)
    assert got(df) == want
    more = spark.createDataFrame([(*r, "x", 1, b"") for r in sample(2, 40, 6)], KIND + ", node string, depth int, digest binary")
    assert got(more) == plain(sample(2, 40, 6))


def test_the_sql_gives_the_same(spark):
    rows = sample(5, 120, 14)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    said = con.execute(f"SELECT {', '.join(NAMES)} FROM ({trie.ORACLE})").fetchall()
    assert sorted(said, key=str) == plain(rows) == got(spark.createDataFrame(rows, KIND))


def test_small_tables(spark):
    assert got(spark.createDataFrame([], KIND)) == []
    assert got(spark.createDataFrame([(None, 1, "user", "x")], KIND)) == []
    for c in range(12):  # some are turnless after rebuilding
        rows = [(c, 0, "user", "x")]
        assert got(spark.createDataFrame(rows, KIND)) == plain(rows)
    rows = [(c, None, None, None) for c in (5, 5, 5, 6, 6)]
    assert got(spark.createDataFrame(rows, KIND)) == plain(rows)


def test_member_lists_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    ids = random.Random(3).sample(range(-500, 5000), 400)
    df = spark.createDataFrame([(i, b"a" if k % 3 else b"b") for k, i in enumerate(ids)], "conv_id long, node binary").repartition(6)
    said = {bytes(r["node"]): r["ends_sha256"] for r in trie.member_digests(df).collect()}
    for key, own in ((b"a", [i for k, i in enumerate(ids) if k % 3]), (b"b", ids[::3])):
        assert said[key] == hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()
