"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC times and Arrow transfer; conf overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
