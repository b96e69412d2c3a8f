"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.components import connected
from quillon.llm.storage import written

BITS = 64
#: Numbers of tables to try; the first that brings together RECALL of measured pairs is taken, else the last.
TABLE_COUNTS, RECALL = (8, 12, 16, 24, 32, 48, 64), 0.97


def key_bits(rows: int) -> int:
    """Bits of a key for so many vectors: whole bytes, 16 for up to four million, so buckets of unlike vectors stay small."""
    return min(56, max(16, 8 * math.ceil((math.log2(max(1, rows)) - 6) / 8)))


def tables_of(width: int, count: int) -> np.ndarray:
    """(count, width) code bits of each table's key: runs, every fourth bit, then drawn ones."""
    rng = np.random.default_rng(0)
    steps = [np.roll(np.arange(BITS), -16 * t)[:width] for t in range(4)]
    steps += [np.concatenate([np.arange((t + k) % 4, BITS, 4) for k in range(4)])[:width] for t in range(4)]
    return np.sort(np.array([*steps, *(rng.permutation(BITS)[:width] for _ in range(max(0, count - 8)))])[:count], axis=1)


@dataclass(frozen=True)
class Quantiser:
    """Codes are the signs of (x / |x| - mean) @ axes."""

    mean: np.ndarray
    axes: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 40, seed: int = 0) -> Quantiser:
        """Rotate the principal axes so that the data lie close to the corners of a cube: signs, then Procrustes, in turn.

        Vectors of fewer than 64 components get several rotations from different starts, of more the first 64 axes of
        one rotation of them all.
        """
        d = x.shape[1]
        if not len(x):
            return cls(np.zeros(d), np.random.default_rng(seed).normal(size=(d, BITS)))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        mean = x.mean(axis=0)
        _, axes = np.linalg.eigh(np.cov(x - mean, rowvar=False).reshape(d, d) if len(x) > 1 else np.eye(d))
        v, found = (x - mean) @ axes, []
        rng = np.random.default_rng(seed)
        while sum(a.shape[1] for a in found) < BITS:
            turn, _ = np.linalg.qr(rng.normal(size=(d, d)))
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (u @ w).T
            found.append(axes @ turn)
        return cls(mean, np.concatenate(found, axis=1)[:, :BITS])

    def codes(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.ascontiguousarray(np.packbits((x - self.mean) @ self.axes >= 0, axis=1, bitorder="little")).view("<u8").ravel()


def table_keys(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(n, tables) keys of the codes."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((len(codes), len(tables), 8), np.uint8)
    padded[:, :, : tables.shape[1] // 8] = np.packbits(bits[:, tables], axis=2, bitorder="little")
    return padded.view("<i8")[:, :, 0]


def measured_tables(model: Quantiser, x: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """The fewest tables under which sample vectors meet enough of their neighbours at the threshold's very angle.

    A neighbour is the vector turned by that angle in a random direction, the hardest link there is to find; data with a
    common direction need more tables than centred ones.
    """
    if len(x) < 2 or x.shape[1] < 2 or not -1 < threshold < 1:
        return tables_of(width, TABLE_COUNTS[0])
    rng = np.random.default_rng(1)
    x = _unit(x[:2000])
    side = rng.normal(size=x.shape)
    side = _unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    near = threshold * x + np.sqrt(1 - threshold**2) * side
    own, other = model.codes(x), model.codes(near)
    for count in TABLE_COUNTS:
        tables = tables_of(width, count)
        if (table_keys(own, tables) == table_keys(other, tables)).any(axis=1).mean() >= RECALL:
            break
    return tables


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).astype(np.float64).reshape(len(column), -1)


ROW = "label bigint, t int, key bigint, block_a bigint, block_b bigint, own bigint, id bigint, copies bigint, code bigint, vec binary"
OUT = "kind int, id bigint, other bigint, n bigint"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _run_links(x, ids, copies, codes, own, across, table, threshold, tables):
    """(edges a, b that join what links join, count of links per member) for one run of a table.

    A pair counts in the first table in which it meets, and there in one run: of two blocks, only pairs across them.
    """
    n = len(ids)
    counts, label = np.zeros(n, np.int64), np.arange(n)
    keys = table_keys(codes, tables)
    for settle in range(n + 1):
        low = label.copy()
        for at in range(0, n, 256):
            near = x[at : at + 256] @ x.T >= threshold
            i, j = np.nonzero(near)
            i = i + at
            keep = i != j
            i, j = i[keep], j[keep]
            np.minimum.at(low, i, label[j])
            if settle == 0:
                first = (keys[i] == keys[j]).argmax(axis=1) == table
                if across:
                    first &= own[i] != own[j]
                np.add.at(counts, i[first], copies[j[first]])
        np.minimum.at(low, label, low)
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    member = np.flatnonzero(label != np.arange(n))
    return ids[member], ids[label[member]], counts


def _scan(batches, kind: str, threshold: float, most: int | None, tables: np.ndarray):
    """Runs of equal (label, t, key, blocks) in a sorted partition; a run of more than `most` rows is handed back as it is."""
    names = [x.split()[0] for x in ROW.split(", ")]
    held: list[pa.RecordBatch] = []
    size, passing, mark = 0, False, None

    def out(kinds, a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["kind", "id", "other", "n"])

    def solve():
        table = pa.Table.from_batches(held)
        get = lambda c: np.asarray(table[c], np.int64)
        ids = get("id")
        if len(ids) < 2:
            return
        a, b, counts = _run_links(_unit(_vectors(table["vec"], kind)), ids, get("copies"), get("code").view(np.uint64), get("own"), get("block_a")[0] != get("block_b")[0], int(get("t")[0]), threshold, tables)
        hit = np.flatnonzero(counts)
        yield out(np.r_[np.zeros(len(a)), np.ones(len(hit))], np.r_[a, ids[hit]], np.r_[b, ids[hit]], np.r_[np.zeros(len(a), np.int64), counts[hit]])

    def hand_on():
        for b in held:
            t = np.asarray(b["t"], np.int64)
            yield out(np.full(len(t), 2), np.asarray(b["id"], np.int64), t, np.asarray(b["key"], np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(names.index(c)), np.int64) for c in ("label", "t", "key", "block_a", "block_b")], axis=1)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cut, cut[1:]):
            if mark is not None and not np.array_equal(mark, keys[lo]):
                if held:
                    yield from solve()
                held, size, passing = [], 0, False
            mark = keys[lo]
            held.append(batch.slice(lo, hi - lo))
            size += hi - lo
            if most is not None and (passing or size > most):
                yield from hand_on()
                held, passing = [], True
    if held:
        yield from solve()


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, sample: int = 20_000, most: int = 4096) -> DataFrame:
    """(key, n_links, component) per row; rows link if their labels are equal and their cosine is at least threshold.

    Vectors that are null, empty, zero, hold null or non-finite components, and rows with a null key or label link with
    nothing: n_links 0, their own component. Labels of any type are told apart by a 64-bit hash; vectors of different
    lengths don't link, and each length has its own quantiser. Equal vectors are one node; their copies are counted, not
    paired. A quantiser is fitted on about `sample` distinct vectors; every row is indexed. A pair is found if its codes
    agree on the key of one of the tables, whose number the sample decides and whose keys widen with the rows, and is
    then decided by the cosine in double precision, so no link below the threshold is ever reported. In a bucket a task
    multiplies blocks of vectors and returns counts and a spanning forest, no pairs; a bucket of more than `most`
    vectors is cut into blocks that meet two by two, each in a task of its own.
    """
    single = df.schema[vector].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"
    base = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    lengths = [r["d"] for r in base.where(whole).groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    out = base.where(~whole).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    for d in lengths:
        out = out.unionByName(_near_of_length(base.where(whole & (F.size("v") == d)), d, kind, threshold, sample, most).withColumnRenamed("id", key))
    return out


def _near_of_length(base: DataFrame, d: int, kind: str, threshold: float, sample: int, most: int) -> DataFrame:
    """(id, n_links, component) of base(id, v, label), whose vectors are sound and of length d."""
    spark = base.sparkSession

    def pack(batches):
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten(), kind)
            raw = flat.tobytes()
            step = d * flat.itemsize
            vec = pa.array([raw[k : k + step] for k in range(0, len(raw), step)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), vec], names=["id", "label", "vec"])

    packed_schema = T.StructType([base.schema["id"], T.StructField("label", T.LongType()), T.StructField("vec", T.BinaryType())])
    packed = written(base.select("id", "label", "v").mapInArrow(pack, packed_schema), "vectors")
    nodes = written(packed.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-nodes")

    total = nodes.count()
    share = min(1.0, sample / max(1, total))
    # The hash of a vector decides, and each distinct vector is one row here: a bounded number in expectation.
    some = nodes.where(F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30)).select("vec").distinct().orderBy("vec").toArrow()
    seen = _vectors(some["vec"], kind) if some.num_rows else np.zeros((0, d))
    quantiser = Quantiser.fit(seen)
    tables = measured_tables(quantiser, seen, threshold, key_bits(total))
    model = spark.sparkContext.broadcast(quantiser)

    def index(batches):
        for batch in batches:
            x = _vectors(batch.column("vec"), kind)
            codes = model.value.codes(x) if len(x) else np.zeros(0, np.uint64)
            keys = table_keys(codes, tables)
            for t in range(len(tables)):
                zero = pa.array(np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.full(len(x), t, np.int32)), pa.array(keys[:, t]), zero, zero, zero, batch.column("id"), batch.column("copies"), pa.array(codes.view(np.int64)), batch.column("vec")], names=[c.split()[0] for c in ROW.split(", ")])

    parts = ["label", "t", "key", "block_a", "block_b"]
    rows = nodes.select("label", "vec", "id", "copies").mapInArrow(index, ROW)
    found = rows.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(lambda b: _scan(b, kind, threshold, most, tables), OUT)
    found = written(found, "vector-links")
    if found.where("kind = 2").limit(1).count():
        hot = found.where("kind = 2").select("id", F.col("other").cast("int").alias("t"), F.col("n").alias("key"))
        own = rows.drop("block_a", "block_b", "own").join(hot, ["id", "t", "key"])
        blocks = own.groupBy("label", "t", "key").agg(F.ceil(F.count("*") / F.lit(most / 2)).cast("long").alias("blocks"))
        own = own.join(blocks, ["label", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
        met = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.withColumns({"block_a": F.least("own", "o"), "block_b": F.greatest("own", "o")}).select(*(c.split()[0] for c in ROW.split(", ")))
        again = met.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(lambda b: _scan(b, kind, threshold, None, tables), OUT)
        found = written(found.where("kind < 2").union(again), "vector-links")
    groups = connected(found.where("kind = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    told = nodes.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    told = told.select("label", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit("second")).alias("h2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    mine = packed.select("id", "label", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit("second")).alias("h2")).join(told, ["label", "h1", "h2"])
    return mine.select("id", "n_links", "component")


def digests(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of embeddings(vec_id, embedding, label)."""
    out = near_vectors(df)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


#: All pairs, exactly; the codes' tables may miss a pair near the threshold (see the recall in the tests).
ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, vec_id = m AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""
