import hashlib
import random
from urllib.parse import quote

import duckdb
import numpy as np
import pytest

from quillon.llm import storage
from quillon.llm import warc as A


def rows():
    rng = random.Random(2)
    fake = A._record("response", 7, "http://x", hashlib.sha256(b"in").hexdigest(), 2, None, b"in", "d").decode()
    bodies = ["", None, "short", "é" * 60, "<p>" + "long " * 500, fake, fake * 3 + "tail", "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "z" * 200, "x" * 100_000]
    out = [(k, rng.choice(["http://a/é b?x=1", None, "http://b/\r\nWARC-Type: y"]), rng.choice(bodies), 1) for k in range(80)]
    rng.shuffle(out)
    return [*out, (None, "u", bodies[4], 1), (None, None, "", 1), (200, "u", "same page " * 30, 1), (200, "u", "same page " * 30, 1), (201, "u", "same page " * 30, 1)]


def plain(pages):
    first = {}
    for k, _, h, _ in pages:
        b = (h or "").encode()
        if len(b) >= 100 and k is not None:
            first[b] = min(k, first.get(b, k))
    out = []
    for k, _, h, _ in pages:
        b = (h or "").encode()
        again = b in first and k != first[b]
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(rows(), "page_id long, url string, html string, size int").repartition(3)


def test_digests_equal_brute_force(pages):
    assert sorted(map(tuple, A.digests(pages).collect()), key=str) == plain(rows())


@pytest.mark.parametrize("block", [64, 5000])
def test_small_files_and_blocks(spark, pages, block):
    manifest = A.write_archives(pages, storage.scratch(spark, "warc"), roll=3_000)
    assert manifest.count() > 5
    found = A.candidates(manifest, block)
    bounds = A.record_bounds(manifest)
    assert bounds.count() == len(rows()) < found.count()
    got = A.read_archives(manifest).collect()
    stored = {bytes(r.payload) for r in got if r.payload is not None}
    assert stored == {(h or "").encode() for _, _, h, _ in rows()}


def test_pointer_jumping():
    start = np.array([0, 10, 15, 30, 40])
    following = np.array([10, 30, 20, 50, 50])
    assert A.reachable(start, following, 50).tolist() == [True, True, False, True, False]
    shuffled = np.array([3, 1, 4, 0, 2])
    assert A.reachable(start[shuffled], following[shuffled], 50).tolist() == [True, True, False, True, False]
    for bad in (np.array([10, 31, 20, 50, 50]), np.array([10, 30, 20, 49, 50])):
        with pytest.raises(ValueError, match="chain"):
            A.reachable(start, bad, 50)


def test_sql_gives_the_same(spark):
    own = [(k, u, h) for k, u, h, _ in rows() if k is not None]
    df = spark.createDataFrame(own, "page_id long, url string, html string")
    con = duckdb.connect()
    table = df.toArrow()
    con.register("pages", table)
    assert sorted(map(str, con.execute(A.ORACLE).fetchall())) == sorted(str(tuple(r)) for r in A.digests(df).collect())


def test_empty_table(pages):
    assert A.digests(pages.limit(0)).count() == 0


def test_urls_stay_whole(spark, tmp_path):
    urls = ["http://a/" + "x" * 200_000, "http://b/" + "é" * 30_000, "http://c/"]
    pages = spark.createDataFrame([(k, u, f"<p>{k}</p>" * 30) for k, u in enumerate(urls)], "page_id long, url string, html string")
    manifest = A.write_archives(pages, "file://" + str(tmp_path))
    got = {r.url for r in A.read_archives(manifest).collect()}
    assert got == {quote(u, safe=":/") for u in urls}
