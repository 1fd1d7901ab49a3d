"""Session settings the jobs are written for.

Only settings that are safe on any cluster: sizes such as the number of
executors or shuffle partitions stay with the deployment.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # let the engine split skewed partitions at run time and merge the small ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # documents may be long, so batches for Python workers are bounded by size
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def builder(app_name: str = "termlens") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made
