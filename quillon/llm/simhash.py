"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit k of the fingerprint gets a non-zero vector m(k) over GF(2) with radius + 1 components. Table v (one for each
non-zero v) keys a fingerprint by its bits with <m(k), v> = 1. The at most `radius` vectors of the bits in which two
fingerprints differ lie in a proper subspace, so some v is orthogonal to all of them: that table's mask skips every
differing bit, and the pair collides there with certainty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.components import connected
from quillon.llm.storage import discard, written
from quillon.llm.textkit import chunks, mix, narrow_batches, utf8_parts

BITS = 64
LANES = np.uint64(0x0000000100000001)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks such that any `radius` bit positions are all outside one of them."""
    vectors = [1 + k % (2 ** (radius + 1) - 1) for k in range(bits)]
    return [sum(1 << k for k, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of each k-word shingle of the ASCII-lower-cased text; all words at once if fewer; none if none."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only and splits at ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, 42)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(size + 1) - 1
    starts = (stops - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, stops[k - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of `counts` hashes: a bit is set if more than half of the hashes have it."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts, half = (np.cumsum(counts) - counts)[full], counts[full].astype(np.uint64)
    for b in range(32):
        both = np.add.reduceat((hashes >> np.uint64(b)) & LANES, starts)
        for lane, n in ((b, both & np.uint64(0xFFFFFFFF)), (b + 32, both >> np.uint64(32))):
            out[full] |= (2 * n > half).astype(np.uint64) << np.uint64(lane)
    return out


def fingerprints(df: DataFrame, text: str = "text", k: int = 4, name: str = "fp") -> DataFrame:
    """df without its text, with `fp bigint`: the 64-bit SimHash of the text's k-word shingles (repeats count).

    Null, empty and blank texts have fingerprint 0. One pass, no shuffle; memory per task is one chunk of 2 MB of
    text, or the longest document.
    """
    held = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([*(df.schema[c] for c in held), T.StructField(name, T.LongType(), False)])

    def run(batches):
        for batch in batches:
            raw, ends = utf8_parts(batch.column(text))
            found = [np.zeros(0, np.int64)]
            for _, _, data, cut in chunks(raw, ends):
                each = [shingle_hashes(data[a:b].tobytes(), k) for a, b in zip(cut[:-1], cut[1:])]
                counts = np.fromiter(map(len, each), np.int64, len(each))
                found.append(majority(np.fromiter((h for hs in each for h in hs), np.uint64, int(counts.sum())), counts).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.select(held).columns, pa.array(np.concatenate(found))], names=[*held, name])

    return narrow_batches(df.select(*held, text)).mapInArrow(run, schema)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _spanning(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest index of its group) that join the same groups as all links within fp do."""
    n = len(fp)
    label = np.arange(n)
    while True:
        low = label.copy()
        for lo in range(0, n, 512):
            near = _near(fp[lo : lo + 512, None], fp[None, :], radius)
            low[lo : lo + 512] = np.where(near, label[None, :], n).min(axis=1)
        np.minimum.at(low, label, low)
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _runs(batches, keys: int, radius: int, most: int | None):
    """Links within runs of equal keys of a sorted partition; runs longer than `most` come back unresolved.

    batches: key columns, then the fingerprint. Yields (kind, a, b): kind 0 is a link (a, b), and kind 1 the row
    (a: table, b: fingerprint) of a run that is too long. A run of up to 32 gives its links, a longer one a spanning
    forest of them.
    """
    kept: list[np.ndarray] | None = None
    passing = None  # the key of a run that is being handed on

    def links(cols):
        fp = cols[-1].view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:-1]])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(fp)))
        a, b = [], []
        end = np.repeat(starts + size, size)
        short = np.flatnonzero(np.repeat(size <= 32, size) & (np.repeat(size, size) > 1))
        for lag in range(1, 32):
            short = short[short + lag < end[short]]
            if not len(short):
                break
            ok = short[_near(fp[short], fp[short + lag], radius)]
            a.append(ok)
            b.append(ok + lag)
        for k in np.flatnonzero(size > 32):
            x, y = _spanning(fp[starts[k] : starts[k] + size[k]], radius)
            a.append(x + starts[k])
            b.append(y + starts[k])
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b))
        return batch(np.zeros(len(a), np.int32), cols[-1][a], cols[-1][b])

    def batch(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    for got in batches:
        cols = [np.asarray(c, np.int64) for c in got.columns]
        if not len(cols[0]):
            continue
        if kept is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(kept, cols)]
        if passing is not None:
            same = np.logical_and.reduce([c == k for c, k in zip(cols[:-1], passing)])
            n = int(np.argmin(same)) if not same.all() else len(same)
            yield batch(np.ones(n, np.int32), cols[0][:n], cols[-1][:n])
            cols = [c[n:] for c in cols]
            if not len(cols[0]):
                kept = None
                continue
            passing = None
        differs = np.logical_or.reduce([c != c[-1] for c in cols[: keys]])
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        done, kept = [c[:last] for c in cols], [c[last:] for c in cols]
        if most is not None and last:
            new = np.ones(last, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in done[:-1]])
            size = np.diff(np.append(np.flatnonzero(new), last))
            long = np.repeat(size > most, size)
            if long.any():
                yield batch(np.ones(int(long.sum()), np.int32), done[0][long], done[-1][long])
                done = [c[~long] for c in done]
        if len(done[0]):
            yield links(done)
        if most is not None and len(kept[0]) > most:
            passing = [c[0] for c in kept[:-1]]
            yield batch(np.ones(len(kept[0]), np.int32), kept[0], kept[-1])
            kept = None
    if kept is not None and len(kept[0]):
        yield links(kept)


def near_links(fps: DataFrame, radius: int = 4, most: int = 4096) -> DataFrame:
    """Links (a, b) that join the same groups as all pairs of distinct fingerprints fps(fp) within the radius.

    Each fingerprint goes to all tables, tables are sorted by key in shuffle partitions, and a task compares inside
    runs of equal keys. Runs of more than `most` fingerprints are cut into blocks of about most / 2, and every two
    blocks of a run meet in a task of their own; so no task holds more than a bounded number of rows, whatever the
    size of a bucket, and no pair is missed.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(m).cast("long").alias("mask")) for v, m in enumerate(signed)])).alias("t")
    rows = fps.select("fp", table).select(F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
    schema = "kind int, a bigint, b bigint"
    first = rows.repartition("v", "key").sortWithinPartitions("v", "key", "fp").mapInArrow(lambda x: _runs(x, 2, radius, most), schema)
    first = written(first, "simhash-links")
    links = first.where("kind = 0").select("a", "b")
    if first.where("kind = 1").limit(1).count():
        pick = F.create_map(*[x for v, m in enumerate(signed) for x in (F.lit(v).cast("long"), F.lit(m).cast("long"))])
        hot = first.where("kind = 1").select(F.col("a").alias("v"), F.col("b").bitwiseAND(pick[F.col("a")]).alias("key"), F.col("b").alias("fp"))
        sizes = hot.groupBy("v", "key").agg(F.ceil(F.count("*") / F.lit(most / 2)).cast("long").alias("n"))
        own = hot.join(sizes, ["v", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), "n"))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        met = met.select("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        links = links.union(met.repartition("v", "key", "i", "j").sortWithinPartitions("v", "key", "i", "j", "fp").mapInArrow(lambda x: _runs(x, 4, radius, None), schema).select("a", "b"))
    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4, most: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, fp, component) per row of df: fingerprints within the radius link, component is the smallest key reachable.

    Equal fingerprints are one node with its smallest key, so copies are never paired; links exist between distinct
    fingerprints only. Null, empty and blank texts share fingerprint 0 and link like any other. A row whose key is null
    gets its component's smallest key, null if that has none. Repeated rows each appear. An empty table gives no rows.
    """
    fps = written(fingerprints(df.select(key, *carry, text), text, k), "simhash")
    nodes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    groups = connected(near_links(nodes.select("fp"), radius, most).select("a", "b"))
    placed = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    placed = written(placed, "simhash-groups")
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(placed.join(least, "root").select("fp", "component"), "fp").select(key, *carry, "fp", "component")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of documents(doc_id, text)."""
    return near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


PAIRED = 512  # documents of a band that one task compares with all others of it
ROWS, BANDS = 4, 20  # a pair of similarity 0.8 misses all bands with a probability of (1 - 0.8 ** 4) ** 20, about 3e-5


def sketches(df: DataFrame, text: str = "text", k: int = 5) -> DataFrame:
    """df without its text, with `name bigint` of the set of k-word shingles, `fp bigint`, its SimHash, and `bands array<bigint>`, its MinHash bands.

    Texts with equal sets have equal names; texts without a word have name 0, fp 0 and no bands.
    """
    held = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in held), T.StructField("name", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    odd = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
    turn = mix(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(2001, 2001 + BANDS, dtype=np.uint64))

    def one(text: bytes) -> tuple[int, int, list[int]]:
        h = np.unique(np.array(shingle_hashes(text, k), np.uint64))
        if not len(h):
            return 0, 0, []
        mixed = mix(h)
        least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(mixed), 4096):
            x = mixed[lo : lo + 4096, None] * odd[None, :]
            np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
        bands = mix((mix(least.reshape(BANDS, ROWS)) * turn).sum(axis=1, dtype=np.uint64) + salt)
        return int(mixed.sum(dtype=np.uint64).view(np.int64)) or 1, int(majority(h, np.array([len(h)])).view(np.int64)[0]), bands.view(np.int64).tolist()

    def run(batches):
        for batch in batches:
            raw, ends = utf8_parts(batch.column(text))
            got = [one(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.select(held).columns, pa.array([n for n, _, _ in got], pa.int64()), pa.array([f for _, f, _ in got], pa.int64()), pa.array([b for _, _, b in got], pa.list_(pa.int64()))], names=[*held, "name", "fp", "bands"])

    return narrow_batches(df.select(*held, text)).mapInArrow(run, schema)


def _alike(pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges (a, b) of those pairs(a, b, p, q) whose texts p and q have that Jaccard similarity of shingle sets."""

    def run(batches):
        for batch in batches:
            a, b, p, q = (batch.column(c) for c in ("a", "b", "p", "q"))
            sets = [[set(shingle_hashes(x.encode("utf-8", "replace"), k)) for x in c.to_pylist()] for c in (p, q)]
            ok = pa.array([len(x & y) >= similarity * len(x | y) - 1e-9 for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    return narrow_batches(pairs.select("a", "b", "p", "q"), 100).mapInArrow(run, "a bigint, b bigint")


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, carry: tuple[str, ...] = (), radius: int = 4) -> DataFrame:
    """(key, *carry, name, component) per row of df: texts whose k-word shingle sets have a Jaccard similarity of at least `similarity` link.

    Candidates are the links of SimHash fingerprints of the sets within `radius` bits, found by the covering masks, and, for
    pairs farther apart (at 0.8 about 10 bits), texts that share a MinHash band (a pair at 0.8 does with probability
    0.99997). Both are verified on their texts; so no pair below the similarity links. Each member of a band meets the band's first; then members of different groups in
    one band meet. Component is the smallest key reachable; texts without a word are one group.
    """
    rows = written(sketches(df.select(key, *carry, text, F.xxhash64(text).alias("th")), text, k), "sketches")
    nodes = written(rows.groupBy("name").agg(F.min(key).alias("least"), F.min("th").alias("th"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "sketch-nodes")
    texts = df.select(F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    # Equal sets are one node; one shuffle of the bands serves the counts and the rows.
    bands = nodes.select("name", F.explode("bands").alias("band")).repartition("band")
    counted = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("name").alias("rep")).where("n > 1")
    met = written(bands.join(counted.hint("shuffle_hash"), "band"), "bands-met")

    def checked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))).distinct()
        wanted = nodes.select("name", "th").join(ends, "name", "left_semi")
        held = written(wanted.join(texts, "th").groupBy("name").agg(F.first("t").alias("t")), "sketch-texts")
        left, right = held.select(F.col("name").alias("a"), F.col("t").alias("p")), held.select(F.col("name").alias("b"), F.col("t").alias("q"))
        edges = written(_alike(pairs.join(left, "a").join(right, "b"), k, similarity), "sketch-edges")
        discard(held)
        return edges

    # Sets of equal fingerprint meet the first of them, and the first ones of linked fingerprints meet.
    firsts = written(nodes.where("name != 0").groupBy("fp").agg(F.min("name").alias("a")), "simhash-firsts")
    of = lambda end: firsts.select(F.col("fp").alias(f"fp_{end}"), F.col("a").alias(end))
    linked = near_links(firsts.select("fp"), radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(of("a"), "fp_a").join(of("b"), "fp_b")
    hashed = nodes.where("name != 0").join(firsts, "fp").select("a", F.col("name").alias("b")).union(linked.select("a", "b")).where("a != b")
    banded = met.where("name != rep").select(F.col("rep").alias("a"), F.col("name").alias("b"))
    stars = written(banded.union(hashed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "sketch-stars")
    discard(firsts)
    edges = checked(stars)
    groups = written(connected(edges), "sketch-groups")
    # Further pairs of a band only between documents not yet in one group; each row meets a slice of the others.
    tagged = met.where("n > 2").join(groups.withColumnRenamed("node", "name"), "name", "left").select("band", "n", "name", F.coalesce("component", "name").alias("c"))
    mixed = tagged.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("band")
    left = written(tagged.join(mixed, "band", "left_semi").withColumn("salts", F.ceil(F.col("n") / PAIRED).cast("int")), "bands-open")
    right = left.select("band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("name").alias("b"), F.col("c").alias("d"))
    rest = left.withColumn("salt", F.pmod("name", "salts").cast("int")).withColumnRenamed("name", "a").join(right, ["band", "salt"]).where("a < b and c != d").select("a", "b").distinct()
    rest = written(rest.join(stars, ["a", "b"], "left_anti"), "sketch-rest")
    if rest.limit(1).count():
        groups = written(connected(edges.union(checked(rest))), "sketch-groups")
    discard(met, stars, left, rest)
    placed = nodes.join(groups.withColumnRenamed("node", "name"), "name", "left").select("name", "least", F.coalesce("component", "name").alias("root"))
    placed = written(placed, "sketch-placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(placed.join(least, "root").select("name", "component"), "name").select(key, *carry, "name", "component")
