"""Folders of files as entries, through Spark's own file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path below root, kind, size, mtime and, if asked for, content of every file."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.unix_micros("modificationTime")
    prefix = root.rstrip("/")
    out = got.select(
        F.regexp_extract("path", r"^(?:[a-z0-9]+:/*)?(/.*)$", 1).alias("full"), F.lit("file").alias("kind"), F.col("length").alias("size"), F.floor(at / 1_000_000).cast("long").alias("mtime_secs"), (F.pmod(at, F.lit(1_000_000)) * 1000).cast("int").alias("mtime_nanos"), *(["content"] if content else [])
    )
    inside = prefix.split(":", 1)[-1].lstrip("/")
    return out.withColumn("path", F.concat(F.lit("/"), F.substring_index("full", f"{inside}/", -1))).drop("full")
