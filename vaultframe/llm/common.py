"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes: space, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the checkpoint folder set on it. Where neither is set, a local session (as in tests) gets a temporary one; on a cluster that is an error, as a folder of one machine would lose what executors write."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vaultframe-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Rows of documents to an Arrow batch: with Spark's 10,000 the JVM and each Python worker hold tens of MB of text several times.
BATCH = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, set to give Python at most BATCH rows at a time; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))
    return spark


_scopes: list[list[str]] = []


@contextmanager
def intermediates() -> Iterator[list[str]]:
    """Names the folders that written() makes in its block; remove(spark, path) drops one."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


_kept: dict[str, SparkSession] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() made."""
    _kept.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is the cluster's to clear then
        return


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_kept.items()):
        remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is removed when the driver's Python ends, or by remove()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vaultframe-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    df.write.parquet(path)
    _kept[path] = spark
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot from this share of all rows on; so there are at most so many.
HOT = 1024


def attached(rows: DataFrame, counts: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """rows with the columns of info (one row for each key at most; null where there is none). counts: (key, c), how many rows have it.

    A left join without hot tasks: keys of more than a HOT-th of all rows, at most HOT, are broadcast, rows of null keys are joined with nothing, and all others meet by shuffles.
    """
    total = counts.agg(F.sum("c")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("c") * HOT > total).select(key))  # at most HOT rows
    known = rows.filter(F.col(key).isNotNull())
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in info.schema.fields if f.name != key]
    out = known.join(hot, key, "left_anti").join(info, key, "left")
    out = out.unionByName(known.join(F.broadcast(info.join(hot, key, "left_semi").join(hot, key, "right")), key))
    return out.unionByName(rows.filter(F.col(key).isNull()).select(*rows.columns, *nulls))


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions of the session, as a number for keyed repartitions that Python stages follow."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Hands memory that a batch has left over back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of a string column each (one longer text stays whole), to bound the memory of vectorised work."""
    text = batch.column(column)
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int32 if text.type == pa.string() else np.int64, len(text) + 1, text.offset * (4 if text.type == pa.string() else 8)).astype(np.int64)
    start = 0
    while start < len(text):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        end = min(end, len(text))
        yield batch.slice(start, end - start)
        start = end


def parts(text: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of a string array with about `most` bytes each, as pieces() gives them."""
    for part in pieces(pa.RecordBatch.from_arrays([text], ["text"]), "text", most):
        yield part.column(0)
