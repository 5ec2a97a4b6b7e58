"""Session settings this library is built for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE sizes partitions, splits skewed joins and picks broadcast joins by measured size. Exact medians
# use object aggregation, which gives up hashing at 128 groups per task unless told otherwise.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    "spark.sql.session.timeZone": "UTC",
    # no call-site lookup for every expression while a plan is put together
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
