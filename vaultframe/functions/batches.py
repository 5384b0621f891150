"""How much of a table Python gets at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch: with Spark's own 10,000 rows the JVM and each Python worker hold tens of MB of blobs several times, and rows of a MB in GB.
MOST = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, set to give Python at most so many rows and bytes at a time; smaller settings stay."""
    for key, most in MOST.items():
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    return spark
