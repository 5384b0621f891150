"""Chunks that arrive continuously: each digest passes once, whatever the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_chunks(chunks: DataFrame) -> DataFrame:
    """The first of each digest of a stream. Digests never expire, so there is no watermark: the state is the set of them."""
    return chunks.dropDuplicates(["digest"])


def into_store(chunks: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Runs until what is there is taken: new chunks go to a Parquet store, partitioned by the first two digits of the digest."""
    out = new_chunks(chunks).withColumn("prefix", F.substring("digest", 1, 2))
    return out.writeStream.format("parquet").option("path", store_path).option("checkpointLocation", checkpoint).partitionBy("prefix").trigger(availableNow=True).start()


def snapshots(events: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Arrivals (ts, size) counted by window; late ones are waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
