"""Deduplication of chunks by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marked(chunks: DataFrame, store: DataFrame | None = None, order: tuple[str, ...] = ("stream", "pos")) -> DataFrame:
    """chunks with exists: false for the first of a digest in order, unless the store has it.

    The first place of a digest is a partial aggregate, so a digest that many chunks share is no hot key of a window.
    """
    first = chunks.groupBy("digest").agg(F.min(F.struct(*order)).alias("__first"))
    out = chunks.join(first, "digest").withColumn("exists", F.struct(*order) > F.col("__first")).drop("__first")
    if store is None:
        return out
    known = store.select("digest", F.lit(True).alias("__known")).distinct()
    return out.join(known, "digest", "left").withColumn("exists", F.col("exists") | F.coalesce("__known", F.lit(False))).drop("__known")


def statistics(chunks: DataFrame) -> DataFrame:
    """Hits, total, and bytes with and without repeats of marked chunks."""
    return chunks.agg(F.count_if("exists").alias("hits"), F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~F.col("exists"), F.col("size"))), F.lit(0)).alias("new_bytes"))


def to_insert(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks that the store lacks, each digest once."""
    return chunks.join(store.select("digest").distinct(), "digest", "left_anti").dropDuplicates(["digest"])


def insert(chunks: DataFrame, store_path: str) -> DataFrame:
    """Appends what is new to a Parquet store, partitioned by the first two digits of the digest; returns the store."""
    spark = chunks.sparkSession
    try:
        store = spark.read.parquet(store_path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store = None
    new = to_insert(chunks, store) if store is not None else chunks.dropDuplicates(["digest"])
    new.withColumn("prefix", F.substring("digest", 1, 2)).write.mode("append").partitionBy("prefix").parquet(store_path)
    return spark.read.parquet(store_path)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("digest").intersect(b.select("digest"))


def new(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.select("digest").distinct().join(previous.select("digest"), "digest", "left_anti")


def all_digests(*snapshots: DataFrame) -> DataFrame:
    out = snapshots[0].select("digest")
    for s in snapshots[1:]:
        out = out.union(s.select("digest"))
    return out.distinct()


def referenced(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks that an index names."""
    return chunks.join(index.select("digest"), "digest", "left_semi")
