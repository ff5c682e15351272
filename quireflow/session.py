"""Sessions as this engine expects them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results rely on, and adaptive execution, which splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quireflow", **more: str) -> SparkSession:
    """A session with SETTINGS and what is given besides; the master and sizes are left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
