"""Benchmark decontamination by spaced seeds.

A passage counts as leaked if, on one alignment without gaps, some window of `window` consecutive words (the whole
item, if it is shorter) agrees in all but a fifth of the words; of items of fewer than SHORT words all must agree. Fixed
masks pick some positions of a stretch of words and ignore the others; benchmark and documents are hashed under the
same masks and joined by hash, and around each hit the words themselves are compared. The masks below are complete for windows of 20 words: every way to place four
differing words leaves one mask intact somewhere, so the result is what brute force gives.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.storage import written
from quillon.llm.textkit import chunks, code_points, mix, narrow_batches, ragged, utf8_parts, word_hashes

WINDOW = 20
# Positions that count, of stretches of 7, 10 and 8 words.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 5, 7, 8, 9), (0, 1, 2, 3, 6, 7))
SHORT = 8
PAIRS = 1 << 18  # meetings of a document's and the benchmark's words that are looked at together


def allowed(n: int) -> int:
    """Differing words allowed in a window of n words: a fifth, none in short ones."""
    return n // 5 if n >= SHORT else 0


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """Complete masks for windows of n words: the spaced ones, or a run that differing words can't break for less than 20."""
    if n >= WINDOW:
        return MASKS
    k = allowed(n)
    return (tuple(range(-(-(n - k) // (k + 1)))),)


def mask_hash(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the counting positions for each start; len(words) - span + 1 of them."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, off in enumerate(mask):
        h += words[off : off + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 | 1)
    return mix(h)


@dataclass
class SeedIndex:
    """Benchmark words of one block and, for each mask, sorted hashes with the word position of each."""

    items: list[bytes]
    words: np.ndarray
    ends: np.ndarray
    tables: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, items: list[bytes], words: list[np.ndarray]) -> SeedIndex:
        size = np.array([len(w) for w in words], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate([*words, np.zeros(0, np.uint64)])
        wanted: dict[tuple[int, ...], list[int]] = {}
        for k, n in enumerate(size):
            for mask in masks_for(int(n)):
                wanted.setdefault(mask, []).append(k)
        tables = []
        for mask, own in wanted.items():
            h = np.concatenate([mask_hash(words[k], mask) for k in own])
            at = np.concatenate([np.arange(ends[k], ends[k] + max(0, size[k] - mask[-1])) for k in own])
            order = np.argsort(h, kind="stable")
            bits = max(16, int(len(h)).bit_length() + 5)
            present = np.zeros(1 << bits, bool)
            present[h >> np.uint64(64 - bits)] = True
            tables.append((mask, h[order], at[order], present))
        return cls(items, flat, ends, tables)

    def search(self, words: np.ndarray, cut: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, words that agree, window, first word of the window) for each leaked pair: its best window.

        Hits are expanded so many at a time that PAIRS bounds their meetings with benchmark positions (or one hit's, at
        most the block's words), however often a hash occurs; each slice is verified before the next is made.
        """
        item_of = np.repeat(np.arange(len(self.items)), np.diff(self.ends))
        out: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for mask, hashes, at, present in self.tables:
            h = mask_hash(words, mask)
            hit = np.flatnonzero(present[h >> np.uint64(64 - int(len(present)).bit_length() + 1)])
            lo, hi = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            before, part = np.concatenate([[0], np.cumsum(n)]), 0
            while part < len(hit):
                stop = max(part + 1, int(np.searchsorted(before, before[part] + PAIRS, "right")) - 1)
                own, base, many = hit[part:stop], lo[part:stop], n[part:stop]
                part = stop
                q = at[ragged(base, many)]
                p = np.repeat(own, many)
                doc = np.searchsorted(cut, p, "right") - 1
                inside = p + mask[-1] < cut[doc + 1]
                p, q, doc = p[inside], q[inside], doc[inside]
                item = item_of[q]
                found = np.unique(np.stack([doc, item, p - (q - self.ends[item])], axis=1), axis=0)
                for few in range(0, len(found), 4096):
                    self._verify(found[few : few + 4096], words, cut, out)
        return list(out.values())

    def _verify(self, found: np.ndarray, words: np.ndarray, cut: np.ndarray, out: dict) -> None:
        """Compare words along alignments (document, item, first word); leaks better than those in out replace them."""
        size = np.diff(self.ends)
        doc, item, start = found.T
        first, last = np.maximum(start, cut[doc]), np.minimum(start + size[item], cut[doc + 1])
        span = last - first
        window = np.minimum(size[item], WINDOW)
        where = ragged(first, span)
        same = words[where] == self.words[ragged(self.ends[item] + first - start, span)]
        total = np.concatenate([[0], np.cumsum(same)])
        base = np.cumsum(span) - span
        places = np.maximum(span - window + 1, 0)
        ok = np.flatnonzero(places)
        if not len(ok):
            return
        at = ragged(base[ok], places[ok])
        agree = total[at + np.repeat(window[ok], places[ok])] - total[at]
        opens = np.cumsum(places[ok]) - places[ok]
        best = np.maximum.reduceat(agree, opens)
        leaks = best >= window[ok] - np.where(window[ok] >= SHORT, window[ok] // 5, 0)
        for k, b, o, m in zip(ok[leaks], best[leaks], opens[leaks], places[ok][leaks]):
            w = int(first[k] + np.argmax(agree[o : o + m] == b))
            key = (int(doc[k]), int(item[k]))
            new = (*key, int(b), int(window[k]), w)
            if key not in out or (-new[2], new[4]) < (-out[key][2], out[key][4]):
                out[key] = new


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, mark, words) of the benchmark, made by the executors: the hashes of its words, and a digest of them.

    Texts without a word (null, too) have no row. Items of equal words have equal marks.
    """
    schema = T.StructType([benchmark.schema[item], T.StructField("mark", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        for batch in batches:
            raw, ends = utf8_parts(batch.column(text))
            marks, words = [], []
            for _, _, data, cut in chunks(raw, ends):
                h, _, _, of = word_hashes(*code_points(data, cut))
                words += [h[a:b].tobytes() for a, b in zip(of[:-1], of[1:])]
            marks = [hashlib.blake2b(w, digest_size=16).digest() if w else None for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(item), pa.array(marks, pa.binary()), pa.array(words, pa.binary())], names=[item, "mark", "words"])

    return narrow_batches(benchmark.select(item, text)).mapInArrow(run, schema).where("mark is not null")


def benchmark_blocks(items: DataFrame, block_words: int = 400_000):
    """Indexes over benchmark_items(), the stated query set, in blocks of bounded size; each is made when it is asked for.

    Items of equal words are one entry. An item larger than a block is a block of its own.
    """
    marks, words, total = [], [], 0
    for row in items.groupBy("mark").agg(F.first("words").alias("words")).toLocalIterator():
        marks.append(bytes(row["mark"]))
        words.append(np.frombuffer(bytes(row["words"]), np.uint64))
        total += len(words[-1])
        if total >= block_words:
            yield SeedIndex.build(marks, words)
            marks, words, total = [], [], 0
    if marks:
        yield SeedIndex.build(marks, words)


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = 400_000) -> DataFrame:
    """One row per leaked (document, item): key, item, matched, window, start, stop, passage.

    matched of `window` words agree, at code points [start, stop) of the document, whose text there is passage; the
    best window is given, the first of equals. Words are runs of letters and digits, lower-cased. Clean documents have
    no row; null and empty texts are clean; each of repeated rows is searched, of any length. Items may have ids of any
    type, null too, and equal texts: each has its rows. Items without a word leak nowhere. The key and item columns must
    have different names. A block's index (bounded) is broadcast and the documents are scanned once per block without
    any shuffle, so frequent passages cannot skew anything; only the leaks meet the items' ids in a join.
    """
    own = {"mark", "matched", "window", "start", "stop", "passage"}
    if key == item or {key, item} & own:
        raise ValueError(f"the columns {key!r} and {item!r} need names of their own, apart from {sorted(own)}")
    schema = T.StructType([documents.schema[key], T.StructField("mark", T.BinaryType()), T.StructField("matched", T.LongType()), T.StructField("window", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("passage", T.StringType())])

    def scan(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                raw, ends = utf8_parts(batch.column(text))
                for lo, _, data, cut in chunks(raw, ends):
                    points, at = code_points(data, cut)
                    words, first, stop, of = word_hashes(points, at)
                    out = []
                    for d, k, agree, window, w in index.search(words, of):
                        a, b = int(first[w]), int(stop[w + window - 1])
                        out.append((lo + d, index.items[k], agree, window, a - int(at[d]), b - int(at[d]), points[a:b].tobytes().decode("utf-32-le")))
                    if out:
                        cols = list(zip(*out))
                        arrays = [batch.column(key).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[2:6]), pa.array(cols[6], pa.string())]
                        yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        return narrow_batches(documents.select(key, text)).mapInArrow(run, schema)

    items = written(benchmark_items(benchmark, item, item_text), "benchmark-items")
    found = None
    for index in benchmark_blocks(items, block_words):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        part = written(scan(shared), "leaks")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], T.StructType([documents.schema[key], benchmark.schema[item], *schema.fields[2:]]))
    return found.join(items.select("mark", item), "mark").select(key, item, *schema.names[2:])


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = 400_000) -> DataFrame:
    """The rows of documents, whole and unchanged, in which leaks() finds nothing; one pass per block, no shuffle."""
    out = documents
    items = written(benchmark_items(benchmark, item, item_text), "benchmark-items")
    for k, index in enumerate(benchmark_blocks(items, block_words)):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        if k:  # one block's index is held at a time
            out = written(out, "clean")

        def run(batches, shared=shared):
            for batch in batches:
                raw, ends = utf8_parts(batch.column(text))
                keep = np.ones(batch.num_rows, bool)
                for lo, _, data, cut in chunks(raw, ends):
                    words, _, _, of = word_hashes(*code_points(data, cut))
                    keep[[lo + found[0] for found in shared.value.search(words, of)]] = False
                yield batch.filter(pa.array(keep))

        out = narrow_batches(out).mapInArrow(run, documents.schema)
    return out


#: All alignments that share a run of equal words: one of 20 words with 4 differing has a run of 4, shorter windows of 3.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
items AS (SELECT row_number() OVER () AS b, item_id, text FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT r, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')) AS t, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), 1) AS k FROM docs),
placed AS (SELECT r, t, k, sum(length(t)) OVER (PARTITION BY r ORDER BY k) AS stop FROM cut),
dw AS (SELECT r, lower(t) AS w, stop - length(t) AS start, stop, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS p FROM placed WHERE regexp_matches(t, '^[\p{L}\p{N}]')),
bc AS (SELECT b, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) - 1 AS p FROM items),
bn AS (SELECT b, count(*) AS n, least(count(*), 20) AS win, CASE WHEN count(*) >= 16 THEN 4 ELSE least(3, count(*)) END AS g FROM bc GROUP BY 1),
bw AS (SELECT * FROM bc JOIN bn USING (b)),
bg AS (SELECT b, p, g, string_agg(w, ' ') OVER (PARTITION BY b ORDER BY p ROWS BETWEEN CURRENT ROW AND g - 1 FOLLOWING) AS x FROM bw QUALIFY count(*) OVER (PARTITION BY b ORDER BY p ROWS BETWEEN CURRENT ROW AND g - 1 FOLLOWING) = g),
dg AS (SELECT r, p, g, string_agg(w, ' ') OVER (PARTITION BY r, g ORDER BY p ROWS BETWEEN CURRENT ROW AND g - 1 FOLLOWING) AS x FROM dw, (SELECT DISTINCT g FROM bn)),
hits AS (SELECT DISTINCT dg.r, bg.b, dg.p - bg.p AS s FROM dg JOIN bg ON dg.x = bg.x AND dg.g = bg.g),
same AS (SELECT h.r, h.b, h.s, d.p, bw.win, (d.w = bw.w)::INT AS y FROM hits h JOIN bw ON bw.b = h.b JOIN dw d ON d.r = h.r AND d.p = h.s + bw.p),
best AS (SELECT r, b, p, win, sum(y) OVER f AS agree FROM same WINDOW f AS (PARTITION BY r, b, s ORDER BY p ROWS BETWEEN CURRENT ROW AND win - 1 FOLLOWING) QUALIFY count(*) OVER f = win),
top AS (SELECT * FROM best WHERE agree >= win - CASE WHEN win >= 8 THEN win // 5 ELSE 0 END QUALIFY row_number() OVER (PARTITION BY r, b ORDER BY agree DESC, p) = 1)
SELECT doc_id, item_id, agree::BIGINT AS matched, win::BIGINT AS "window", a.start::BIGINT AS start, z.stop::BIGINT AS stop, substring(docs.text, a.start::BIGINT + 1, (z.stop - a.start)::BIGINT) AS passage
FROM top JOIN docs USING (r) JOIN items USING (b) JOIN dw a ON a.r = top.r AND a.p = top.p JOIN dw z ON z.r = top.r AND z.p = top.p + win - 1
"""
