"""Training on streams: every micro-batch is one data-parallel gradient step or one merge of moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.stats import Moments, merge, moments
from quillon.operators.layers import Trainer


class RunningMoments:
    """Means and scatter of a stream of features, exact over all batches seen; equal to one pass over their union."""

    def __init__(self, features: str = "features"):
        self.features, self.moments, self._last = features, None, -1

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch; a batch that is delivered again is not counted again."""
        if epoch <= self._last or batch.isEmpty():
            return
        now: Moments = moments(batch, self.features)
        self.moments = now if self.moments is None else merge(self.moments, now)
        self._last = epoch


class OnlineTrainer:
    """A Trainer fed by foreachBatch."""

    def __init__(self, trainer: Trainer, features: str = "features", target: str = "target"):
        self.trainer, self.features, self.target, self.losses, self._last = trainer, features, target, [], -1

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self._last or batch.isEmpty():
            return
        self.losses += self.trainer.fit_distributed(batch, 1, self.features, self.target)
        self._last = epoch


def score_stream(stream: DataFrame, model, features: str = "features") -> DataFrame:
    """A fitted model's predictions on a stream: the same projection as on a table."""
    return model.predict(stream, features)


def windowed_loss(scored: DataFrame, time: str, y: str = "y", prediction: str = "prediction", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean squared error by time window, with a watermark for late rows."""
    error = (F.col(y) - F.col(prediction)) * (F.col(y) - F.col(prediction))
    return scored.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.avg(error).alias("mse"), F.count("*").alias("n"))
