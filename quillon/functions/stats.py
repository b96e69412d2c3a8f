"""Sufficient statistics in one pass: moments and products of features, merged from partial sums of each partition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """n, means and centred scatter of the columns (features, then the target if there is one)."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray


def matrix(column: pa.Array) -> np.ndarray:
    """An array<double> column of equal lengths as a 2-D array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def merge(a: Moments, b: Moments) -> Moments:
    """Pairwise update of centred moments, stable where sums of squares are not."""
    n = a.n + b.n
    if not n:
        return a
    shift = b.mean - a.mean
    return Moments(n, a.mean + shift * (b.n / n), a.scatter + b.scatter + np.outer(shift, shift) * (a.n * b.n / n))


def moments(df: DataFrame, features: str = "features", target: str | None = None) -> Moments:
    """One scan; each task returns one small matrix, and the driver merges as many as there are tasks.

    Tasks' matrices are merged in two levels on the executors when there are many of them.
    """
    cols = [F.col(features).alias("x"), *([F.col(target).cast("double").alias("y")] if target else [])]

    def partial(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            if target:
                x = np.column_stack([x, np.asarray(batch.column("y"), np.float64)])
            mean = x.mean(0)
            now = Moments(len(x), mean, (x - mean).T @ (x - mean))
            held = now if held is None else merge(held, now)
        if held is not None:
            yield pack(held)

    def pack(m):
        return pa.RecordBatch.from_arrays([pa.array([float(m.n)]), pa.array([m.mean.tolist()]), pa.array([m.scatter.ravel().tolist()])], names=["n", "mean", "scatter"])

    def combine(batches):
        held = None
        for batch in batches:
            for n, mean, scatter in zip(*(c.to_pylist() for c in batch.columns)):
                now = Moments(n, np.array(mean), np.array(scatter).reshape(len(mean), -1))
                held = now if held is None else merge(held, now)
        if held is not None:
            yield pack(held)

    schema = "n double, mean array<double>, scatter array<double>"
    parts = df.select(*cols).mapInArrow(partial, schema)
    rows = parts.repartition(16).mapInArrow(combine, schema).collect()
    out = None
    for r in sorted(rows, key=lambda r: (r["n"], r["mean"])):
        now = Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1))
        out = now if out is None else merge(out, now)
    if out is None:
        raise ValueError("no rows")
    return out


def triangle(df: DataFrame, features: str = "features", target: str | None = None, ones: bool = True) -> np.ndarray:
    """R of a QR factorisation of [1 | X | y], square and upper triangular, from one scan.

    Tasks factor their rows piece by piece, and factors are stacked and factored again in two levels (tall-skinny QR). X'X
    is never formed, which would square the condition number and lose small singular values. Without its first row and
    column (ones) R is the factor of the centred columns, and R[0] holds their means times R[0, 0], whose square is the count.
    """
    cols = [F.col(features).alias("x"), *([F.col(target).cast("double").alias("y")] if target else [])]

    def pack(r):
        return pa.RecordBatch.from_arrays([pa.array([r.shape[1]], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["d", "r"])

    def square(r):
        return np.vstack([r, np.zeros((max(0, r.shape[1] - len(r)), r.shape[1]))])

    def joined(parts):
        held = None
        for x in parts:
            held = np.linalg.qr(x if held is None else np.vstack([held, x]), mode="r")
        return held

    def pieces(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                x = np.column_stack([*([np.ones(len(x))] if ones else []), x, *([np.asarray(batch.column("y"), np.float64)] if target else [])])
                yield from (x[lo : lo + 4096] for lo in range(0, len(x), 4096))

    def packed(batches):
        for batch in batches:
            for d, r in zip(batch.column("d").to_pylist(), batch.column("r").to_pylist(), strict=True):
                yield np.frombuffer(r).reshape(-1, d)

    def partial(batches):
        held = joined(pieces(batches))
        if held is not None:
            yield pack(square(held))

    def combine(batches):
        held = joined(packed(batches))
        if held is not None:
            yield pack(square(held))

    rows = df.select(*cols).mapInArrow(partial, "d long, r binary").repartition(16).mapInArrow(combine, "d long, r binary").collect()
    if not rows:
        raise ValueError("no rows")
    return square(joined(np.frombuffer(bytes(r["r"])).reshape(-1, r["d"]) for r in sorted(rows, key=lambda r: bytes(r["r"]))))


def sums(df: DataFrame, kernel, size: int, columns: list) -> np.ndarray:
    """The sum over all rows of a vector of `size` numbers that kernel(*arrays) adds up for a batch.

    The iterative solvers' aggregate: one job; each task's vector is one packed row, and at most 16 sums of such rows
    reach the driver.
    """

    def pack(v):
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])


    def partial(batches):
        held = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                held += kernel(*(matrix(c) if pa.types.is_list(c.type) else np.asarray(c, np.float64) for c in batch.columns))
        yield pack(held)

    def combine(batches):
        held = np.zeros(size)
        for batch in batches:
            for raw in batch.column("v").to_pylist():
                held += np.frombuffer(raw)
        yield pack(held)

    rows = df.select(*columns).mapInArrow(partial, "v binary").repartition(16).mapInArrow(combine, "v binary").collect()
    return np.sum([np.zeros(size), *sorted((np.frombuffer(bytes(r["v"])) for r in rows), key=lambda v: v.tobytes())], axis=0)
