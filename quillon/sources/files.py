"""File sources: gzipped IDX images and labels, and whole text files."""

from __future__ import annotations

import gzip
import os
import struct
import urllib.request

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Names of the files, and the magic numbers of their formats.
MNIST_FILES = {"train": ("train-images-idx3-ubyte.gz", "train-labels-idx1-ubyte.gz"), "test": ("t10k-images-idx3-ubyte.gz", "t10k-labels-idx1-ubyte.gz")}
MNIST_URL = "https://storage.googleapis.com/cvdf-datasets/mnist/"
IMAGE_MAGIC, LABEL_MAGIC = 2051, 2049
SHAKESPEARE_URL = "https://raw.githubusercontent.com/karpathy/char-rnn/master/data/tinyshakespeare/input.txt"


def parse_idx_images(raw: bytes) -> np.ndarray:
    """(n, pixels) in [0, 1], row by row."""
    magic, n, rows, cols = struct.unpack_from(">IIII", raw)
    if magic != IMAGE_MAGIC:
        raise ValueError(f"not an image file: {magic}")
    return np.frombuffer(raw, np.uint8, n * rows * cols, 16).reshape(n, -1) / 255


def parse_idx_labels(raw: bytes) -> np.ndarray:
    magic, n = struct.unpack_from(">II", raw)
    if magic != LABEL_MAGIC:
        raise ValueError(f"not a label file: {magic}")
    return np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)


def _fetch(path: str, url: str, download: bool) -> None:
    if not os.path.exists(path):
        if not download:
            raise FileNotFoundError(path)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        urllib.request.urlretrieve(url, path)


def load_mnist(spark: SparkSession, data_dir: str = ".cache/mnist", download: bool = True) -> dict[str, DataFrame]:
    """{'train', 'test'}: (row_id, features, y); the two files of a part are read and parsed by a task."""
    out = {}
    for part, names in MNIST_FILES.items():
        for name in names:
            _fetch(os.path.join(data_dir, name), MNIST_URL + name, download)
        files = spark.read.format("binaryFile").load([os.path.join(data_dir, n) for n in names]).select("path", "content").coalesce(1)

        def parse(batches):
            held = {}
            for batch in batches:
                for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                    raw = gzip.decompress(content)
                    held["x" if "images" in path.rsplit("/", 1)[-1] else "y"] = parse_idx_images(raw) if "images" in path.rsplit("/", 1)[-1] else parse_idx_labels(raw)
            for at in range(0, len(held.get("y", ())), 1000):
                x, y = held["x"][at : at + 1000], held["y"][at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(y))), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y)], names=["row_id", "features", "y"])

        out[part] = files.mapInArrow(parse, "row_id long, features array<double>, y long")
    return out


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file as one string."""
    return spark.read.text(path, wholetext=True)


def load_tiny_shakespeare(spark: SparkSession, data_path: str = ".cache/tiny-shakespeare/input.txt", download: bool = True) -> DataFrame:
    _fetch(data_path, SHAKESPEARE_URL, download)
    return load_text(spark, data_path)


def save_parameters(spark: SparkSession, parameters: list[np.ndarray], path: str) -> None:
    """A checkpoint: one row per parameter array."""
    rows = [(k, list(p.shape), p.ravel().tolist()) for k, p in enumerate(parameters)]
    spark.createDataFrame(rows, "k int, shape array<int>, v array<double>").write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> list[np.ndarray]:
    return [np.array(r["v"]).reshape(r["shape"]) for r in spark.read.parquet(path).orderBy("k").collect()]
