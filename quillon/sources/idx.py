"""IDX files as a partitioned data source: spark.read.format("idx").load(path), after register(spark).

The driver reads a file's header only; each task reads a range of bytes of it from the storage where it lies. A gzipped
file has no ranges: decompress it, or read it with load_mnist().
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The type byte of the format, and the numbers that it stands for.
KINDS = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}

#: Bytes that one task reads.
RANGE = 64 << 20


def _open(path: str):
    from pyarrow import fs

    files, own = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return files, own


def header(path: str, raw: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, sizes, length of the header) from a file's first bytes; another magic number is an error."""
    if len(raw) < 4 or raw[:2] != b"\0\0" or raw[2] not in KINDS or not raw[3] or len(raw) < 4 + 4 * raw[3]:
        raise ValueError(f"not an IDX file: {path}")
    return np.dtype(KINDS[raw[2]]), struct.unpack_from(f">{raw[3]}I", raw, 4), 4 + 4 * raw[3]


@dataclass
class Slice(InputPartition):
    """Some items of a file: where they start, how many there are and the numbers in each."""

    path: str
    kind: str
    offset: int
    first: int
    items: int
    width: int


class IdxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Slice]:
        from pyarrow import fs

        files, own = _open(self.path)
        found = files.get_file_info(own)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [own] if found.type == fs.FileType.File else sorted(i.path for i in files.get_file_info(fs.FileSelector(own)) if i.type == fs.FileType.File)
        out = []
        for name in names:
            with files.open_input_file(name) as f:
                kind, sizes, start = header(name, f.read(4 + 4 * 255))
                width = int(np.prod(sizes[1:], dtype=np.int64))
                item = width * kind.itemsize
                if f.size() < start + sizes[0] * item:
                    raise ValueError(f"{name} ends early")
            step = max(1, self.range // max(1, item))
            out += [Slice(name, kind.str, start + at * item, at, min(step, sizes[0] - at), width) for at in range(0, sizes[0], step)]
        return out or [Slice("", ">u1", 0, 0, 0, 1)]

    def read(self, part: Slice):
        if not part.items:
            return
        files, _ = _open(self.path)
        kind = np.dtype(part.kind)
        with files.open_input_file(part.path) as f:
            for at in range(0, part.items, 4096):
                n = min(4096, part.items - at)
                f.seek(part.offset + at * part.width * kind.itemsize)
                values = np.frombuffer(f.read(n * part.width * kind.itemsize), kind).astype(np.float64)
                ends = pa.array(np.arange(0, n * part.width + 1, max(1, part.width)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([part.path.rsplit("/", 1)[-1]] * n), pa.array(np.arange(part.first + at, part.first + at + n)), pa.ListArray.from_arrays(ends, pa.array(values))], names=["file", "row_id", "v"])


class IdxSource(DataSource):
    """(file, row_id, v): an item's number in its file and its numbers, C order. Options: path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return "file string, row_id long, v array<double>"

    def reader(self, schema) -> IdxReader:
        return IdxReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IdxSource)


def load_labelled(spark: SparkSession, images: str, labels: str, scale: float = 255.0) -> DataFrame:
    """(row_id, features, y) of an image file and its label file."""
    register(spark)
    x = spark.read.format("idx").load(images).select("row_id", F.transform("v", lambda p: p / scale).alias("features"))
    y = spark.read.format("idx").load(labels).select("row_id", F.get("v", F.lit(0)).cast("long").alias("y"))
    return x.join(y, "row_id")
