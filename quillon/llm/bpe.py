"""Byte-level BPE: encoding with vectorised pre-tokenisation, and decoding by retained offsets.

Pre-tokenisation does not use regular expressions. Every code point gets a symbol (letter, number, other, white space
by its place in the run, contraction apostrophe), every symbol is a function on the ten states of a small automaton,
and the functions form a finite monoid whose product is associative. A prefix scan over monoid elements (one table
lookup per composition, about two per code point) therefore yields every state at once, and with it the piece starts.
The pieces, as slices of the UTF-8 bytes, are looked up in a bounded cache of merged pieces; a miss is merged by rank.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.textkit import chunks, code_points, narrow_batches, ragged, utf8_parts

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
# White space beyond ASCII as the rank files' pattern takes it, and the contractions of that pattern.
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_CONTRACTIONS = "stmd"
LONG_CONTRACTIONS = ("re", "ve", "ll")


def class_table() -> bytes:
    """The class of every code point, as tiktoken's own Unicode tables have it.

    Two Unicode databases agree on nearly all code points; those on which they differ (letters and numbers that newer
    versions added) are asked of the library, through a vocabulary that can merge only inside one piece.
    """
    import regex
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    old = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array(["".join(unicodedata.category(c)[0] for c in text)]).view("<U1")
    old[points] = np.select([kinds == "L", kinds == "N"], [LETTER, NUMBER], OTHER)
    new = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            new[[ord(c) for c in m[0]]] = kind
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {bytes([p, b]): 256 * (k + 1) + b for k, p in enumerate(b"a1") for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    for c in np.flatnonzero(old != new).tolist():
        old[c] = next((kind for kind, p in ((LETTER, "a"), (NUMBER, "1")) if probe.encode_ordinary(p + chr(c))[0] >= 256), OTHER)
    old[[*range(9, 14), *WIDE_SPACES]] = BLANK
    old[32] = SPACE
    return old.tobytes()


# States: nothing yet; inside a run; after a space that the next piece takes; inside white space; after the last white
# space of a run; one or two letters of a contraction to come; a contraction ended.
BEGIN, IN_L, IN_N, IN_O, TAKEN, IN_W, LAST_W, ONE_LEFT, TWO_LEFT, ENDED = range(10)
# Symbols: letter, number, other, apostrophe before a contraction of one or two letters, space or other white space
# before a piece, white space before white space or the end.
SYM_L, SYM_N, SYM_O, SYM_A1, SYM_A2, SYM_SP, SYM_LAST, SYM_W = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts here)."""
    if symbol == SYM_L:
        if state in (TWO_LEFT, ONE_LEFT):
            return (ONE_LEFT if state == TWO_LEFT else ENDED), False
        return IN_L, state not in (IN_L, TAKEN)
    if symbol == SYM_N:
        return IN_N, state not in (IN_N, TAKEN)
    if symbol == SYM_SP:
        return TAKEN, True
    if symbol == SYM_LAST:
        return LAST_W, True
    if symbol == SYM_W:
        return IN_W, state != IN_W
    if state in (IN_O, TAKEN):
        return IN_O, False
    return {SYM_O: IN_O, SYM_A1: ONE_LEFT, SYM_A2: TWO_LEFT}[symbol], True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, with a document's start in the second half; products; images; starts by state, symbol)."""
    maps = [tuple(_step(s, y)[0] for s in range(10)) for y in range(8)]
    maps += [(_step(BEGIN, y)[0],) * 10 for y in range(8)]
    known = {tuple(range(10)): 0}
    for m in maps:
        known.setdefault(m, len(known))
    queue = list(known)
    while queue:
        m = queue.pop()
        for g in maps:
            product = tuple(g[x] for x in m)
            if product not in known:
                known[product] = len(known)
                queue.append(product)
    images = np.array(list(known), np.uint8)
    kind = np.uint8 if len(known) <= 256 else np.uint16
    product = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], kind)
    return np.array([known[m] for m in maps], kind), product, images, np.array([[_step(s, y)[1] for y in range(8)] for s in range(10)])


def prefix_scan(x: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Exclusive prefix products by up- and down-sweep: neighbours combine in pairs, level by level."""
    flat, m, levels, n = product.ravel(), product.shape[1], [], len(x)
    while len(x) > 1:
        if len(x) % 2:
            x = np.append(x, x.dtype.type(0))
        levels.append(x)
        x = flat[x[0::2].astype(np.intp) * m + x[1::2]]
    before = np.zeros(1, product.dtype)
    for level in reversed(levels):
        out = np.empty(len(level), product.dtype)
        before = before[: len(level) // 2]
        out[0::2] = before
        out[1::2] = flat[before.astype(np.intp) * m + level[0::2]]
        before = out
    return before[:n]


def piece_starts(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Code-point positions at which a piece starts; ends: document offsets among the code points."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes[points]
    final = np.zeros(n + 1, bool)
    final[ends[1:][ends[1:] > 0] - 1] = True
    opens = np.zeros(n + 1, bool)
    opens[ends[:-1]] = True
    opens, final = opens[:n], final[:n]
    blank = kind >= BLANK
    before_piece = np.append(~blank[1:], False) & ~final
    symbol = np.array([SYM_L, SYM_N, SYM_O, SYM_W, SYM_W], np.uint8)[kind]
    last = np.flatnonzero(blank & before_piece)
    symbol[last] = np.where(kind[last] == SPACE, SYM_SP, SYM_LAST)
    at = np.flatnonzero(points == 39)
    at = at[~final[at]]
    if len(at):
        padded = np.append(points, [0, 0])
        one, two, can = padded[at + 1], padded[at + 2], ~np.append(final, [True, True])[at + 1]
        short = np.isin(one, [ord(c) for c in SHORT_CONTRACTIONS])
        long = can & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in LONG_CONTRACTIONS])
        symbol[at[long]] = SYM_A2
        symbol[at[short]] = SYM_A1
    elements, product, images, starts = _monoid()
    before = prefix_scan(elements[symbol + 8 * opens.astype(np.uint8)], product)
    state = images[before, BEGIN]
    state[opens] = BEGIN
    return np.flatnonzero(starts[state, symbol])


class PieceCache(dict):
    """piece -> number of its entry; entries are runs of one flat id array. Bounded: emptied between chunks.

    A miss is merged by the tokenizer library's routine for single pieces (n log n for long ones).
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 200_000):
        import tiktoken

        super().__init__()
        self.limit = limit
        self.merge = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.flat, self.ends = array("i"), array("q", [0])

    def __missing__(self, piece: bytes) -> int:
        self.flat.extend(self.merge(piece))
        self.ends.append(len(self.flat))
        self[piece] = k = len(self.ends) - 2
        return k

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.flat, self.ends = array("i"), array("q", [0])


@lru_cache(maxsize=4)
def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=4)
def token_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat bytes, start and length by id)."""
    ranks = parse_ranks(raw)
    top = max(ranks.values()) + 1
    start, length, at, flat = np.zeros(top, np.int64), np.zeros(top, np.int64), 0, []
    for token, k in ranks.items():
        start[k], length[k] = at, len(token)
        flat.append(token)
        at += len(token)
    return np.frombuffer(b"".join(flat), np.uint8), start, length


def encode_chunk(raw: np.ndarray, ends: np.ndarray, classes: np.ndarray, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the chunk's documents one after the other, offsets of the documents among them)."""
    points, point_ends = code_points(raw, ends)
    starts = piece_starts(points, point_ends, classes)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
    data = raw.tobytes()
    at = starts if len(points) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
    cut = at.tolist()
    cut.append(len(data))
    entry = np.fromiter(map(cache.__getitem__, [data[a:b] for a, b in zip(cut, cut[1:])]), np.int64, len(at))
    entry_ends = np.frombuffer(cache.ends, np.int64)
    counts = entry_ends[entry + 1] - entry_ends[entry]
    ids = np.frombuffer(cache.flat, np.int32)[ragged(entry_ends[entry], counts)]
    del entry_ends
    before = np.concatenate([[0], np.cumsum(counts)])
    cache.trim()
    return ids, before[np.searchsorted(at, ends)]


def _list_array(values: list[np.ndarray], lengths: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.concatenate([*lengths, np.zeros(0, np.int64)]))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]).astype(np.int32)))


def _shared(spark, path: str):
    with open(path, "rb") as f:
        ranks = f.read()
    return spark.sparkContext.broadcast((ranks, class_table()))  # under 2 MB, however large the corpus


def _slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 23):
    """Row slices of at most limit bytes of one column (or one row), so that one output batch stays bounded."""
    col = batch.column(column)
    width = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]) if len(col) else []
    lo = total = 0
    for k, w in enumerate(width):
        if k > lo and total + w > limit:
            yield batch.slice(lo, k - lo)
            lo, total = k, 0
        total += int(w)
    if lo < batch.num_rows:
        yield batch.slice(lo)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str = "token_offsets") -> DataFrame:
    """df with `ids array<int>` and `token_offsets array<int>`: the byte offset in the text's UTF-8 where each token ends.

    Each match of the rank files' pattern is merged by itself; no special tokens. A null or empty text has no tokens;
    all other columns pass through, and columns already named ids or offsets are replaced. One pass, no shuffle. Memory
    per task: one slice of 8 MB of text (or the longest document), its arrays, and a cache of at most 200,000 pieces.
    """
    held = [c for c in df.columns if c not in (ids, offsets)]
    shared = _shared(df.sparkSession, path)
    schema = T.StructType([*(df.schema[c] for c in held), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(offsets, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        raw_ranks, table = shared.value
        ranks, classes = parse_ranks(raw_ranks), np.frombuffer(table, np.uint8)
        _, _, lengths = token_bytes(raw_ranks)
        cache = PieceCache(ranks)
        for whole in batches:
            for batch in _slices(whole, text):
                raw, ends = utf8_parts(batch.column(text))
                values, offs, counts = [], [], []
                for _, _, data, cut in chunks(raw, ends):
                    got, among = encode_chunk(data, cut, classes, cache)
                    n = np.diff(among)
                    done = np.cumsum(lengths[got])
                    offs.append((done - np.repeat(cut[:-1], n)).astype(np.int32))
                    values.append(got)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([*batch.select(held).columns, _list_array(values, counts), _list_array(offs, counts)], names=[*held, ids, offsets])

    return narrow_batches(df.select(*held)).mapInArrow(run, schema)


def decode_chunk(token: np.ndarray, offsets: np.ndarray, among: np.ndarray, vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the documents one after the other, offsets of the documents among them); every token goes to its retained offset.

    among: the documents' offsets among the tokens. An id outside the vocabulary, or offsets that contradict the
    tokens' lengths, are errors.
    """
    flat, start, length = vocabulary
    if len(token) and (token.min() < 0 or token.max() >= len(length)):
        raise ValueError("an id is not in the vocabulary")
    size = length[token]
    done = np.concatenate([[0], np.cumsum(size)])
    if not np.array_equal(done[1:] - np.repeat(done[among[:-1]], np.diff(among)), offsets):
        raise ValueError("offsets don't match the tokens")
    return flat[ragged(start[token], size)], done[among]


def decode(df: DataFrame, path: str, ids: str = "ids", offsets: str = "token_offsets", decoded: str = "decoded") -> DataFrame:
    """df with `decoded binary`, the bytes of the ids; every token is placed at the offset retained by encode().

    An id outside the vocabulary, or offsets that contradict the tokens' lengths, are errors. No tokens give empty bytes.
    """
    held = [c for c in df.columns if c != decoded]
    shared = _shared(df.sparkSession, path)
    schema = T.StructType([*(df.schema[c] for c in held), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches):
        vocabulary = token_bytes(shared.value[0])
        for whole in batches:
            lists = whole.column(ids)
            among = np.asarray(lists.offsets, np.int64)
            for lo, hi, _, cut in chunks(np.empty(int(among[-1] - among[0]), np.uint8), among - among[0]):
                a, b = int(among[lo]), int(among[hi])
                data, ends = decode_chunk(np.asarray(lists.values[a:b], np.int64), np.asarray(whole.column(offsets).values[a:b], np.int64), cut, vocabulary)
                column = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.select(held).columns, column], names=[*held, decoded])

    return narrow_batches(df.select(*held)).mapInArrow(run, schema)


def recode(df: DataFrame, path: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """df without its text, with n_tokens, ids_sha256, decoded_sha256, and the ids if a name is given for them.

    encode() and decode() in one pass over each chunk of text: offsets and decoded bytes stay in the task and only their
    digests leave it. Columns of the same names are replaced. Null and empty texts have no tokens.
    """
    new = [*([ids] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    held = [c for c in df.columns if c != text and c not in new]
    shared = _shared(df.sparkSession, path)
    types = {ids: T.ArrayType(T.IntegerType(), False), "n_tokens": T.LongType()}
    schema = T.StructType([*(df.schema[c] for c in held), *(T.StructField(c, types.get(c, T.StringType()), False) for c in new)])

    def run(batches):
        raw_ranks, table = shared.value
        vocabulary, classes = token_bytes(raw_ranks), np.frombuffer(table, np.uint8)
        cache, said = PieceCache(parse_ranks(raw_ranks)), [b"%d" % k for k in range(len(vocabulary[2]))]
        for batch in batches:
            raw, ends = utf8_parts(batch.column(text))
            for lo, hi, data, cut in chunks(raw, ends):
                got, among = encode_chunk(data, cut, classes, cache)
                n = np.diff(among)
                offsets = np.cumsum(vocabulary[2][got]) - np.repeat(cut[:-1], n)
                back, back_ends = decode_chunk(got, offsets, among, vocabulary)
                back, words = back.tobytes(), list(map(said.__getitem__, got.tolist()))
                own = [_list_array([got], [n])] if ids else []
                own.append(pa.array(n, pa.int64()))
                own.append(pa.array([hashlib.sha256(b" ".join(words[a:b])).hexdigest() for a, b in zip(among[:-1], among[1:])]))
                own.append(pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(back_ends[:-1], back_ends[1:])]))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).select(held).columns, *own], names=[*held, *new])

    return narrow_batches(df.select(*held, text)).mapInArrow(run, schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents(doc_id, text), encoded and decoded."""
    return recode(df.select("doc_id", "text"), path)
