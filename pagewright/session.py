"""Sessions with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "pagewright", **options: str) -> SparkSession:
    """A session; ``options`` are further settings, with ``__`` for the dots of their names."""
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in options.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
