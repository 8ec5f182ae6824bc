"""SparkSession with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "docloom", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling and coalescing, UTC, Arrow; other settings are left to the cluster."""
    builder = (
        SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
