"""Binary chunk indexes: read with Spark's own functions, written as bytes."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.functions import scalars as S

# Fixed values of the format.
FIXED = bytes((47, 127, 65, 237, 145, 253, 15, 205))
DYNAMIC = bytes((28, 145, 78, 165, 25, 186, 179, 205))
HEADER_SIZE = 4096


def _checked(files: DataFrame, magic: bytes, size: int) -> DataFrame:
    """Fails on files of the wrong kind or with a part of an entry at the end."""
    b = F.col("content")
    sound = (F.octet_length(b) >= HEADER_SIZE) & (F.substring(b, 1, 8) == F.lit(magic)) & ((F.octet_length(b) - HEADER_SIZE) % size == 0)
    return files.withColumn("content", F.when(sound, b).otherwise(F.raise_error(F.lit("not an index of this kind")).cast("binary")))


def _entries(files: DataFrame, size: int) -> DataFrame:
    n = F.floor((F.octet_length("content") - HEADER_SIZE) / size).cast("int")
    return files.withColumn("pos", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))).withColumn("e", F.substring("content", HEADER_SIZE + 1 + F.col("pos") * size, F.lit(size)))


def dynamic(files: DataFrame) -> DataFrame:
    """stream, pos, end_offset, digest of files (stream, content)."""
    e = _entries(_checked(files, DYNAMIC, 40), 40)
    return e.select("stream", F.col("pos").cast("long").alias("pos"), S.from_le("e", 0, 8).alias("end_offset"), F.lower(F.hex(F.substring("e", 9, 32))).alias("digest"))


def fixed(files: DataFrame) -> DataFrame:
    """stream, pos, end_offset, digest, chunk_size, total_size of files (stream, content)."""
    e = _entries(_checked(files, FIXED, 32).withColumn("total_size", S.from_le("content", 64, 8)).withColumn("chunk_size", S.from_le("content", 72, 8)), 32)
    return e.select("stream", F.col("pos").cast("long").alias("pos"), F.least((F.col("pos") + 1) * F.col("chunk_size"), "total_size").alias("end_offset"), F.lower(F.hex("e")).alias("digest"), "chunk_size", "total_size")


def headers(files: DataFrame) -> DataFrame:
    """stream, uuid, created and csum of either kind of index."""
    return files.select("stream", F.lower(F.hex(F.substring("content", 9, 16))).alias("uuid"), S.from_le("content", 24, 8).alias("created"), F.lower(F.hex(F.substring("content", 33, 32))).alias("csum"))


def encode_dynamic(entries: list[tuple[int, str]], created: int) -> bytes:
    """From (end_offset, digest)."""
    body = b"".join(struct.pack("<Q", end) + bytes.fromhex(d) for end, d in entries)
    uuid = hashlib.sha256(struct.pack("<qQ", created, len(entries))).digest()[:16]
    return (DYNAMIC + uuid + struct.pack("<q", created) + hashlib.sha256(body).digest()).ljust(HEADER_SIZE, b"\0") + body


def encode_fixed(digests: list[str], chunk_size: int, total: int, created: int) -> bytes:
    body = b"".join(map(bytes.fromhex, digests))
    uuid = hashlib.sha256(struct.pack("<qQ", created, total)).digest()[:16]
    return (FIXED + uuid + struct.pack("<q", created) + hashlib.sha256(body).digest() + struct.pack("<QQ", total, chunk_size)).ljust(HEADER_SIZE, b"\0") + body


def dynamic_files(index: DataFrame, created: int) -> DataFrame:
    """An index file for each stream: stream, content. A stream's entries meet in one task, 40 bytes each."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        entries = sorted(zip(*(rows.column(c).to_pylist() for c in ("pos", "end_offset", "digest")), strict=True))
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([encode_dynamic([e[1:] for e in entries], created)], pa.binary())], ["stream", "content"])

    return index.select("stream", "pos", "end_offset", "digest").groupBy("stream").applyInArrow(run, "stream string, content binary")


def fixed_files(chunks: DataFrame, chunk_size: int, created: int) -> DataFrame:
    """The same of chunks of a fixed size (stream, pos, end_offset, digest)."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        entries = sorted(zip(*(rows.column(c).to_pylist() for c in ("pos", "end_offset", "digest")), strict=True))
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([encode_fixed([e[2] for e in entries], chunk_size, entries[-1][1], created)], pa.binary())], ["stream", "content"])

    return chunks.select("stream", "pos", "end_offset", "digest").groupBy("stream").applyInArrow(run, "stream string, content binary")
