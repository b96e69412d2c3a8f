"""Tables written once to the cluster's shared folder and read back, for loops that would otherwise run ever longer plans.

A lost executor then costs the tasks of one step and not all steps before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where all runs in one process, else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillon-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Held:
    """df as a written table; drop() deletes it once no plan reads it any more."""

    def __init__(self, df: DataFrame, name: str, compression: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path, compression=compression)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def add(self, df: DataFrame) -> Held:
        """The table with the rows of df after its own."""
        df.write.mode("append").parquet(self.path)
        self.df = self.spark.read.schema(self.df.schema).parquet(self.path)
        return self

    def drop(self) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *_) -> None:
        self.drop()


def bounded_batches(df: DataFrame, most: int = 1 << 24) -> DataFrame:
    """df, after telling its session to send tasks' Python at most so many bytes at once (or one row).

    The default bounds rows only, and 10,000 rows of long arrays or texts are GBs. A smaller setting is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(key).rstrip("bB")) > most:
        df.sparkSession.conf.set(key, str(most))
    return df


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans, which it keeps until the driver's next garbage collection."""
    spark.sparkContext._jvm.System.gc()
