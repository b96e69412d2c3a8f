"""Token ids in binary shards, with keyed access through minimal perfect hashing.

A shard (`shard-*.ids`) holds consecutive documents of one key range in ascending order, SHARD_BYTES of ids at most
(or one document):
    magic `QTOKENS1`, id width in bytes, documents n, documents with a key (3 x uint64), keys (n x int64),
    ends (n x uint64), raw ids
where ends count ids, the ids are little-endian unsigned integers of that width, and documents without a key come last. An index part (`index-*.mph`)
covers the keys of one hash class: a minimal perfect hash in levels of bit arrays maps each of its n keys to a slot of
its own, and the slot stores the key's fingerprint, shard, row in the shard, and number of rows with that key there.
Rows of a repeated key that go on in later shards are listed behind the slots. A key is found by one hash for the part,
a bit test per level (1.6 levels on average), and one slot; the fingerprint refuses keys that are not there.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.storage import filesystem, put, scratch, written
from quillon.llm.textkit import chunks, mix, narrow_batches, ragged, utf8_parts

MAGIC = b"QTOKENS1"
HEAD = 32
GAMMA, LEVELS = 2.0, 40
CHUNK_BYTES = 1 << 23  # of text that a task encodes at once
SHARD_BYTES = 1 << 26  # of ids; a task writes a shard out and starts the next from here on


def _level(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA24BAED4963EE407 * (level + 1) & (1 << 64) - 1)) % np.uint64(bits)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Levels of bit arrays; a key's slot is the rank of its bit, counted over all levels."""

    sizes: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64. At each level the keys that share a position with none set its bit; the others go on."""
        sizes, arrays, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            n = max(64, int(GAMMA * len(left)))
            at = _level(left, len(sizes), n)
            alone = np.bincount(at.astype(np.int64), minlength=n) == 1
            sizes.append(n)
            arrays.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate([*arrays, np.zeros(0, bool)])
        return cls(np.array(sizes, np.int64), bits, np.cumsum(bits) - bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit (a stranger may still get a slot)."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes.tolist()):
            at = base + _level(keys[left], level, n).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + n
        return out

    def dump(self) -> bytes:
        return struct.pack("<QQ", len(self.sizes), len(self.bits)) + self.sizes.astype("<i8").tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        levels, n = struct.unpack_from("<QQ", raw)
        stop = 16 + 8 * levels + (n + 7) // 8
        sizes = np.frombuffer(raw, "<i8", levels, 16)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, 16 + 8 * levels), count=n).astype(bool)
        return cls(sizes, bits, np.cumsum(bits) - bits), stop


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u8"), ("row", "<u8"), ("count", "<u8")])
MORE = np.dtype([("slot", "<u8"), ("shard", "<u8"), ("row", "<u8"), ("count", "<u8")])


def index_bytes(keys: np.ndarray, shard: np.ndarray, row: np.ndarray, count: np.ndarray) -> bytes:
    """An index part for runs of `count` rows from (shard, row); a key has one run for each shard that holds it."""
    order = np.lexsort((shard, keys))
    keys, shard, row, count = (np.asarray(c)[order] for c in (keys, shard, row, count))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    found = PerfectHash.build(keys[first])
    at = found.slots(keys)
    slots, more = np.zeros(int(first.sum()), SLOT), np.zeros(int((~first).sum()), MORE)
    for name, values in (("fingerprint", fingerprint(keys)), ("shard", shard), ("row", row), ("count", count)):
        slots[name][at[first]] = values[first]
        if name in MORE.names:
            more[name] = values[~first]
    more["slot"] = at[~first]
    return found.dump() + struct.pack("<Q", len(slots)) + slots.tobytes() + np.sort(more, order=("slot", "shard")).tobytes()


class Index:
    """One index part in memory."""

    def __init__(self, raw: bytes):
        self.hash, at = PerfectHash.load(raw)
        (n,) = struct.unpack_from("<Q", raw, at)
        self.slots = np.frombuffer(raw, SLOT, n, at + 8)
        self.more = np.frombuffer(raw, MORE, offset=at + 8 + n * SLOT.itemsize)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the key among keys, its runs as SLOT or MORE records' shard, row and count) for the keys that are there."""
        at = self.hash.slots(keys)
        there = at >= 0
        there[there] = self.slots["fingerprint"][at[there]] == fingerprint(keys[there])
        own = np.flatnonzero(there)
        at = at[own].astype(np.uint64)
        lo, hi = (np.searchsorted(self.more["slot"], at, side) for side in ("left", "right"))
        rest = ragged(lo, hi - lo)
        runs = np.zeros((len(own) + len(rest), 3), np.int64)
        for k, name in enumerate(("shard", "row", "count")):
            runs[: len(own), k], runs[len(own) :, k] = self.slots[name][at], self.more[name][rest]
        return np.concatenate([own, np.repeat(own, hi - lo)]), runs


@lru_cache(maxsize=2)
def _tokenizer(raw: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(raw.decode())
    out.encode_special_tokens = False
    return out


#: The steps before the merges for which WordIds knows the pieces of plain words: white space to blanks, lower case,
#: pieces by this pattern, bytes as letters. They are compared with the tokenizer's own file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-z0-9à-öø-ÿß]+")
#: Words of these are plain: their lower case and their normal form are one code point each, letters are letters.
LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
#: The bytes of À to ÿ as the letters that byte-level tokenizers write for them.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
AS_BYTES = {x: "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in chr(x).encode()) for x in range(0xC0, 0x100)}
STEPS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})


def splits_at_blanks(raw: bytes) -> bool:
    """Whether the tokenizer's file names exactly the steps that WordIds relies on."""
    said = json.loads(raw)
    before, cut = said.get("normalizer") or {}, (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    pattern = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    letters = cut[-1].get("type") == "ByteLevel" and not cut[-1].get("add_prefix_space") and cut[-1].get("use_regex") is False
    plain = not any(said.get(k) for k in ("truncation", "padding", "post_processor"))
    blank = any(" " in t["content"] or "\n" in t["content"] or not t["content"] for t in said.get("added_tokens") or [])
    return plain and not blank and before.get("normalizers") == list(STEPS) and len(cut) == 2 and cut[0] == pattern and letters


class WordIds:
    """Ids by stretch of text between blanks and line feeds, each stretch encoded when it is first met.

    A stretch of printable ASCII and the letters from À to ÿ is cut by the tokenizer's pattern here and the library's model
    merges each piece; any other stretch goes through the whole library. Both hold for tokenizers that splits_at_blanks() accepts; with another
    the library encodes whole texts. The entries are runs of one flat id array; they are dropped between calls once
    there are more than limit, so a vocabulary without end costs time, not memory.
    """

    def __init__(self, raw: bytes, limit: int = 500_000):
        self.tokenizer, self.limit = _tokenizer(raw), limit
        self.model, self.cuts = self.tokenizer.model, splits_at_blanks(raw)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        self.entry, self.pieces, self.flat, self.ends = {"": 0}, {}, array("I"), array("q", [0, 0])

    def _piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = [t.id for t in self.model.tokenize(piece.translate(AS_BYTES))]
        return got

    def _add(self, word: str, ids) -> None:
        self.entry[word] = len(self.ends) - 1
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each)."""
        if not self.cuts:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([k for ids in got for k in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)
        if len(self.entry) > self.limit:
            self._forget()
        # Arrow cuts the texts and numbers the different words, so Python meets each word of a chunk once.
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        flat, cut = words.flatten().dictionary_encode(), np.asarray(words.offsets)
        different = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        other = []
        for w in different:
            if w in self.entry:
                continue
            if LATIN.fullmatch(w) and not ("<" in w and any(x in w for x in self.special)):
                low = w.lower()
                if low.isalpha():
                    self._add(w, self._piece(low))
                else:
                    self._add(w, [k for piece in PLAIN.findall(low) for k in self._piece(piece)])
            else:
                other.append(w)
        for at in range(0, len(other), 10_000):
            for w, got in zip(part := other[at : at + 10_000], self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self._add(w, got.ids)
        which = np.fromiter(map(self.entry.__getitem__, different), np.int64, len(different))[np.asarray(flat.indices)]
        ends = np.frombuffer(self.ends, np.int64)
        counts = ends[which + 1] - ends[which]
        ids = np.frombuffer(self.flat, np.uint32)[ragged(ends[which], counts)] if len(self.flat) else np.zeros(0, np.uint32)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[cut])


def _gathered(batches, size: int):
    """The rows of the batches, of at least `size` bytes at a time: the more text at once, the fewer words are met again."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@lru_cache(maxsize=1)
def _words(raw: bytes) -> WordIds:
    """The ids known in this process: Spark gives a Python process many tasks, and most words come again in the next."""
    return WordIds(raw)


def write_shards(df: DataFrame, folder: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", partitions: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write; returns the manifest rows (shard, file, key, row, n_tokens), one per document.

    Documents are range-partitioned and sorted by key (equal keys by text, null keys last), null texts are
    empty; a document with a null key is stored, but in no index. A task writes its range in shards of shard_bytes, so it
    holds one shard at most (or the ids of the longest document), whatever the range; shards are numbered in the order of
    keys. Ids have the width that the vocabulary needs. The tokenizer file is read once on the driver and broadcast (a
    few MB).
    """
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.substring("text", 1, 32))
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(partitions, F.col("key").asc_nulls_last(), "h").sortWithinPartitions(F.col("key").asc_nulls_last(), "text").drop("h")

    def run(batches):
        words, task = _words(shared.value), TaskContext.get()
        width = 2 if words.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        held = ([], [], [])
        shard, size = task.partitionId() << 24, 0

        def flush():
            nonlocal shard, size, held
            keys, sizes, ids = held
            counts = np.concatenate(sizes)
            name, n = f"shard-{shard:012x}-{task.taskAttemptId()}.ids", len(keys)
            put(f"{folder}/{name}", [MAGIC, struct.pack("<QQQ", width, n, sum(k is not None for k in keys)), np.array([k or 0 for k in keys], "<i8").tobytes(), np.cumsum(counts).astype("<u8").tobytes(), *ids])
            out = pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array([name] * n), pa.array(keys, pa.int64()), pa.array(np.arange(n)), pa.array(counts)], names=["shard", "file", "key", "row", "n_tokens"])
            held, shard, size = ([], [], []), shard + 1, 0
            return out

        for batch in _gathered(batches, CHUNK_BYTES):
            own = batch.column("key").to_pylist()
            raw, ends = utf8_parts(batch.column("text"))
            for lo, hi, part, cut in chunks(raw, ends, min(CHUNK_BYTES, shard_bytes)):
                data = part.tobytes()
                got, n = words.encode([data[a:b].decode() for a, b in zip(cut[:-1], cut[1:])])
                written_ids = np.insert(got, np.cumsum(n), end_id).astype(f"<u{width}").tobytes()
                if size and size + len(written_ids) > shard_bytes:
                    yield flush()
                held[0].extend(own[lo:hi])
                held[1].append((n + 1).astype(np.int64))
                held[2].append(written_ids)
                size += len(written_ids)
        if held[0]:
            yield flush()

    return written(narrow_batches(rows).mapInArrow(run, "shard bigint, file string, key bigint, row bigint, n_tokens bigint"), "tokens-manifest")


def write_index(manifest: DataFrame, folder: str, part_keys: int = 1_000_000) -> int:
    """Write the index parts for the manifest's keys and return their number: about one for part_keys keys."""
    keyed = manifest.where("key is not null")
    runs = keyed.groupBy("key", "shard").agg(F.min("row").alias("row"), F.count("*").alias("count"))
    parts = max(1, -(-keyed.count() // part_keys))
    placed = runs.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        put(f"{folder}/index-{part:06d}.mph", [index_bytes(*(np.asarray(table[c]) for c in ("key", "shard", "row", "count")))])
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([table.num_rows], pa.int64())})

    written(placed.groupBy("part").applyInArrow(build, "part int, n bigint"), "tokens-index")
    return parts


def locate(keys: DataFrame, folder: str, parts: int) -> DataFrame:
    """(key, shard, row) of the rows of each key, by the index; keys that are not there give no row."""
    rows = keys.select("key").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part")

    def run(batches):
        held: dict = {}
        for batch in batches:
            part, key = (np.asarray(c) for c in batch.select(["part", "key"]).columns)
            for p in np.unique(part).tolist():
                if held.get("part") != p:
                    files, path = filesystem(f"{folder}/index-{p:06d}.mph")
                    with files.open_input_file(path) as f:
                        held = {"part": p, "index": Index(f.read())}
                own = key[part == p]
                which, runs = held["index"].find(own)
                shard, row, n = runs.T
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[which], n)), pa.array(np.repeat(shard, n)), pa.array(ragged(row, n))], names=["key", "shard", "row"])

    return rows.where("key is not null").mapInArrow(run, "key bigint, shard bigint, row bigint")


def read_rows(places: DataFrame, files: DataFrame, folder: str, tasks: int = 8) -> DataFrame:
    """(key, shard, row, before, ids) of places(key, shard, row), read from the shard files; before counts the shard's ids ahead of it.

    files(shard, file) names them; tasks is the number of reading tasks, as rows that only point at bytes look too small
    to Spark to be spread. The key stored in the shard must be the one looked for.
    """
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("row", T.LongType()), T.StructField("before", T.LongType()), T.StructField("ids", T.BinaryType())])
    rows = places.join(files, "shard").withColumn("block", F.floor(F.col("row") / 4096)).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "row").select("key", "shard", "file", "row")

    def run(batches):
        held: dict = {}
        for batch in batches:
            out = []
            for key, shard, name, row in zip(*(c.to_pylist() for c in batch.columns)):
                if held.get("name") != name:
                    if held:
                        held["file"].close()
                    store, path = filesystem(f"{folder}/{name}")
                    f = store.open_input_file(path)
                    if f.read_at(8, 0) != MAGIC:
                        raise ValueError(f"{name} is no shard")
                    width, n, keyed = struct.unpack("<QQQ", f.read_at(24, 8))
                    held = {"name": name, "file": f, "width": width, "n": n, "keyed": keyed}
                f, n = held["file"], held["n"]
                (own,) = struct.unpack("<q", f.read_at(8, HEAD + 8 * row))
                if (own if row < held["keyed"] else None) != key:
                    raise ValueError(f"row {row} of {name} has key {own}, not {key}")
                at = HEAD + 8 * n + 8 * row
                start, stop = struct.unpack("<QQ", f.read_at(16, at - 8)) if row else (0, *struct.unpack("<Q", f.read_at(8, at)))
                raw = f.read_at((stop - start) * held["width"], HEAD + 16 * n + start * held["width"])
                out.append((key, shard, row, start, raw if held["width"] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=schema.names)

    return narrow_batches(rows).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, found through the index (null ids: the manifest) and read from the shards."""
    folder = scratch(df.sparkSession, "tokens")
    manifest = write_shards(df, folder, path, partitions=partitions)
    parts = write_index(manifest, folder)
    # One row per file.
    totals = manifest.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    files, ahead = [], 0
    for r in totals:
        files.append((r["shard"], r["file"], ahead))
        ahead += r["n"]
    files = df.sparkSession.createDataFrame(files, "shard bigint, file string, ahead bigint")
    keyless = manifest.where("key is null").select("key", "shard", "row")
    places = locate(manifest.select("key").distinct(), folder, parts).unionByName(keyless)
    rows = read_rows(places, files.select("shard", "file"), folder, max(8, 2 * len(totals)))
    out = rows.join(F.broadcast(files), "shard")  # as many rows as there are shard files
    return out.select(F.col("key").alias("doc_id"), (F.col("ahead") + F.col("before")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
