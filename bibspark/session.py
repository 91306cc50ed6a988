"""Session settings that the engine's results and plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for every timestamp; AQE to coalesce, split skewed joins and switch to broadcast by measured size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("bibspark")
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
