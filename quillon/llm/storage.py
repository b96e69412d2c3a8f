"""Shared storage: the folder all executors see, byte-level access to it, and lineage cut by a written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; only where it is unset and all runs in one process (tests) a local one is made."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that none of taken has, in any letter case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut, sizes are known, executors may be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no plan reads any more, and the shuffle files of finished plans with them."""
    for t in tables:
        drop(t.sparkSession, t.scratch_path)
    forget_shuffles(tables[0].sparkSession)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans, which it keeps until the driver's next garbage collection."""
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) for file:, hdfs:, s3: and the like; used by tasks for byte ranges."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, pieces) -> int:
    """Write byte pieces to uri by way of a temporary name, so that a lost or repeated task never leaves half a file."""
    files, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    part, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with files.open_output_stream(part) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    files.move(part, path)
    return size
