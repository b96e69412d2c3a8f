"""Running statistics of a stream by key, held in Spark's state store.

The state of a key is its count, mean and centred sum of squares. It lives in the store that the query's checkpoint keeps,
so a restarted query goes on where it stopped, and no key's numbers are ever on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningMoments(StatefulProcessor):
    """Adds each batch's values to its key's state and gives the state after it; null values count for nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, squares double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, squares = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        for part in rows:
            values = part["value"].dropna().to_numpy(float)
            if len(values):
                own, shift = len(values), values.mean() - mean
                squares += ((values - values.mean()) ** 2).sum() + shift * shift * n * own / (n + own)
                mean, n = mean + shift * own / (n + own), n + own
        n, mean, squares = int(n), float(mean), float(squares)
        self.state.update((n, mean, squares))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [mean if n else None], "variance": [squares / n if n else None]})

    def close(self) -> None:
        pass


def running_statistics(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, variance): for each batch the keys that it holds, with their statistics over all batches so far.

    The variance is that of the population. Start it with run_available(), or with RocksDB as the state store.
    """
    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(RunningMoments(), f"key {kind}, n long, mean double, variance double", "Update", "None")


def run_available(stats: DataFrame, out: str, checkpoint: str) -> None:
    """Work off what the source holds now, each batch's rows as a folder of Parquet under out, and stop.

    A batch that is delivered again replaces its folder. State is kept in RocksDB, which keyed state needs; the session's
    own choice of a store is set back.
    """
    spark, name = stats.sparkSession, "spark.sql.streaming.stateStore.providerClass"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    own = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set(name, own)


def latest(spark, out: str) -> DataFrame:
    """(key, n, mean, variance): each key's last statistics among the batches under out."""
    rows = spark.read.parquet(out)
    return rows.groupBy("key").agg(F.max_by(F.struct("n", "mean", "variance"), "epoch").alias("s")).select("key", "s.*")
