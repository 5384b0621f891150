"""Groups of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = ".protected"


def listed(paths: DataFrame) -> DataFrame:
    """Snapshots of (type, id, dir): directories whose name is no RFC 3339 time are left out."""
    return paths.withColumn("backup_time", F.unix_seconds(F.try_to_timestamp("dir", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))).filter("backup_time is not null")


def described(files: DataFrame) -> DataFrame:
    """Of (snapshot, filename): the files by name and whether the snapshot is protected; the marker is no file."""
    name = F.col("filename")
    return files.groupBy("snapshot").agg(F.array_sort(F.collect_list(F.when(name != PROTECTED, name))).alias("files"), F.max(name == PROTECTED).alias("protected"))


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Each snapshot (type, id, time) with the time of the one before in its group."""
    return snapshots.withColumn("previous", F.lag("time").over(Window.partitionBy("type", "id").orderBy("time")))
