"""Array views of text columns: UTF-8 bytes, code points, word hashes and ragged gathers, all in numpy.

Every kernel works on chunks of at most `limit` bytes of text (a longer document is a chunk of its own), so memory is
bounded by the longest document and not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 21


def narrow_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, after telling its session to send tasks' Python at most so many rows at once.

    The default of 10,000 suits rows of numbers; texts of unbounded length, and the id arrays made of them, need fewer
    for a task's Arrow buffers to stay within tens of MB on both sides. A smaller setting is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty and ill-formed UTF-8 is replaced."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    try:
        raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        texts = [raw[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return raw, ends


def chunks(raw: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive slices of whole documents."""
    n, lo = len(ends) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def code_points(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of well-formed UTF-8 and the document offsets among them."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    if len(points) == len(raw):
        return points, ends
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, before[ends]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[k], starts[k]+1, ... counts[k] of them, for every k in turn."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total, dtype=np.int64)


@lru_cache(maxsize=1)
def _all_chars() -> np.ndarray:
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0xFFFD
    return points.view("<U1")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.char.isalpha(_all_chars())


@lru_cache(maxsize=1)
def alphanumerics() -> np.ndarray:
    return np.char.isalnum(_all_chars())


@lru_cache(maxsize=1)
def lower_map() -> np.ndarray:
    """Lower-case code point of each code point (the first one where lowering gives several)."""
    return np.char.lower(_all_chars()).astype("<U1").view("<u4").copy()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _char_codes() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64))


def word_hashes(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased alphanumeric words as 64-bit hashes.

    Returns hashes, first and after-last code point of each word, and the document offsets among the words. A word
    never crosses a document's end.
    """
    low = lower_map()[points]
    inside = alphanumerics()[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    doc_starts = ends[:-1][ends[:-1] < len(points)]
    first[doc_starts] = inside[doc_starts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(ends), np.int64)
    size = 1 << max(12, int(len(points)).bit_length())
    power, inverse = _powers(size)
    term = _char_codes()[low]
    term *= power[: len(points)]
    term[~inside] = 0
    with np.errstate(over="ignore"):
        h = np.add.reduceat(term, starts) * inverse[starts]
    before = np.concatenate([[0], np.cumsum(inside)])
    stops = starts + np.diff(np.append(before[starts], before[-1]))
    return mix(h), starts, stops, np.searchsorted(starts, ends)
