"""Chunking of byte streams: of fixed size in the JVM, content-defined in numpy.

The rolling hash of a place is the XOR over its window of 64 bytes of each byte's table value, rotated by the byte's
distance. Six doubling steps give it for every place of a stream at once; only the choice of boundaries walks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.batches import small_batches

WINDOW = 64
#: A value for each byte: the first four bytes of its SHA-256.
TABLE = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


@dataclass(frozen=True)
class Config:
    """Chunk sizes from an average, which is a power of two and at least the window."""

    average: int

    def __post_init__(self):
        if self.average < WINDOW or self.average & (self.average - 1):
            raise ValueError("the average chunk size must be a power of two, 64 or more")

    @property
    def least(self) -> int:
        return self.average // 4

    @property
    def most(self) -> int:
        return self.average * 4

    @property
    def mask(self) -> int:
        return self.average * 2 - 1

    @property
    def threshold(self) -> int:
        return self.mask - 2


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    by %= 32
    return x << np.uint32(by) | x >> np.uint32(32 - by) if by else x


def rolling(data: bytes, table: np.ndarray = TABLE) -> np.ndarray:
    """The hash at every place from the end of the first window on (places before have partial windows)."""
    h = table[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:
        out = h.copy()
        out[span:] ^= _turned(h[:-span], span)
        h, span = out, span * 2
    return h


def boundaries(data: bytes, config: Config, table: np.ndarray = TABLE) -> list[int]:
    """Ends of the chunks. The hash runs on through chunks; a chunk is cut at the most, or once it has the least at a place whose masked hash reaches the threshold; none is cut within the first window."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    marks = np.flatnonzero((rolling(data, table) & np.uint32(config.mask)) >= config.threshold) + 1
    ends, start = [], 0
    while start < n:
        low = max(start + config.least, WINDOW + 1 if not start else 0)
        k = int(np.searchsorted(marks, low))
        end = min(int(marks[k]) if k < len(marks) else n, start + config.most, n)
        ends.append(end)
        start = end
    return ends


def each_chunk(data: bytes, config: Config, got: Callable[[int, bytes], bool | None], table: np.ndarray = TABLE) -> int:
    """Calls got(end, chunk) for each chunk in turn until it returns False; how many calls there were. For one stream that a program holds."""
    start = 0
    for n, end in enumerate(ends := boundaries(data, config, table), 1):
        if got(end, data[start:end]) is False:
            return n
        start = end
    return len(ends)


def read_table(path: str) -> np.ndarray:
    """A byte table of another store from a text file: 256 numbers, decimal or 0x hex, apart by commas or white space."""
    with open(path) as f:
        values = [int(x, 0) for x in f.read().replace(",", " ").split()]
    if len(values) != 256:
        raise ValueError(f"{len(values)} numbers instead of 256")
    return np.array(values, np.uint32)


def fixed(streams: DataFrame, size: int) -> DataFrame:
    """Chunks of fixed size of (stream, data): pos, bounds, digest and blob."""
    n = F.octet_length("data")
    rows = streams.select("stream", "data", F.posexplode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))).alias("pos", "start"))
    blob = F.substring("data", F.col("start") + 1, F.lit(size))
    return rows.select("stream", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start_offset"), (F.col("start") + F.octet_length(blob)).cast("long").alias("end_offset"), F.octet_length(blob).cast("long").alias("size"), F.sha2(blob, 256).alias("digest"), blob.alias("blob"))


def content_defined(streams: DataFrame, config: Config, table: np.ndarray = TABLE) -> DataFrame:
    """Content-defined chunks of (stream, data): pos, bounds, digest and blob. table: 256 numbers of 32 bits by byte; stores chunked with another table need that one."""

    kinds = {"stream": pa.string(), "pos": pa.int64(), "start_offset": pa.int64(), "end_offset": pa.int64(), "size": pa.int64(), "blob": pa.binary()}

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for stream, data in zip(batch.column("stream"), batch.column("data"), strict=True):
                name, body, start = stream.as_py(), data.as_py() or b"", 0
                for pos, end in enumerate(boundaries(body, config, table)):
                    out.append((name, pos, start, end, end - start, body[start:end]))
                    held, start = held + end - out[-1][2], end
                    if held >= OUT:
                        yield made(out)
                        out, held = [], 0
            if out:
                yield made(out)

    small_batches(streams.sparkSession)
    got = streams.select(F.col("stream").cast("string").alias("stream"), "data").mapInArrow(run, "stream string, pos long, start_offset long, end_offset long, size long, blob binary")
    return got.select("stream", "pos", "start_offset", "end_offset", "size", F.sha2("blob", 256).alias("digest"), "blob")


#: Bytes of chunks to a batch that goes to the JVM.
OUT = 4 << 20
#: Least bytes of a block, in which long streams are dealt out.
BLOCK = 1 << 20


def blocks(pieces: DataFrame, size: int, most: int) -> DataFrame:
    """Streams in pieces (stream, start_offset, data) as blocks (stream, b, base, data): each has the bytes of its `size` places, those of a window before them, and at most `most` after them."""
    at, end = F.col("start_offset"), F.col("start_offset") + F.octet_length("data")
    low = F.greatest(F.floor((at - most) / size), F.lit(0)).cast("long")
    dealt = pieces.filter(F.octet_length("data") > 0).select("stream", at.alias("at"), end.alias("end"), "data", F.explode(F.sequence(low, F.floor((end - 1 + WINDOW) / size).cast("long"))).alias("b"))
    begin, stop = F.greatest("at", F.col("b") * size - WINDOW), F.least("end", (F.col("b") + 1) * size + most)
    cut = dealt.filter(begin < stop).select("stream", "b", F.struct(begin.alias("o"), F.substring("data", (begin - F.col("at") + 1).cast("int"), (stop - begin).cast("int")).alias("x")).alias("part"))
    put = cut.groupBy("stream", "b").agg(F.min("part.o").alias("base"), F.max(F.col("part.o") + F.octet_length("part.x")).alias("stop"), F.sum(F.octet_length("part.x")).alias("n"), F.expr("listagg(part.x) WITHIN GROUP (ORDER BY part.o)").alias("data"))
    whole = F.col("base") + F.col("n") == F.col("stop")
    # A last block may have only bytes of the window before it.
    return put.filter(F.col("stop") > F.col("b") * size).select("stream", "b", "base", F.when(whole, F.col("data")).otherwise(F.raise_error(F.lit("bytes of a stream are missing or there twice")).cast("binary")).alias("data"))


def content_defined_pieces(pieces: DataFrame, config: Config, table: np.ndarray = TABLE) -> DataFrame:
    """What content_defined gives, of streams in pieces (stream, start_offset, data), of any length: hashes are taken in blocks, and only the places where a chunk may end meet in one task of a stream."""
    size = max(BLOCK, 4 * config.most)
    found = pa.schema([("stream", pa.string()), ("b", pa.int64()), ("until", pa.int64()), ("marks", pa.list_(pa.int64()))])
    walked = pa.schema([("stream", pa.string()), ("b", pa.int64()), ("pos", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, b, base, data in zip(*(batch.column(c) for c in ("stream", "b", "base", "data")), strict=True):
                body, first = data.as_py(), b.as_py() * size
                until = min(first + size, base.as_py() + len(body))
                h = rolling(body[: until - base.as_py()], table)
                ends = np.flatnonzero((h & np.uint32(config.mask)) >= config.threshold) + 1 + base.as_py()
                yield pa.RecordBatch.from_pylist([{"stream": stream.as_py(), "b": b.as_py(), "until": until, "marks": ends[ends > first]}], schema=found)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s.as_py(), b.as_py(), n.as_py(), np.asarray(m.values)) for batch in batches for s, b, n, m in zip(*(batch.column(c) for c in found.names), strict=True))
        for stream, of in itertools.groupby(rows, lambda x: x[0]):
            start, pos, known, due = 0, 0, np.zeros(0, np.int64), 0
            row = next(of)
            while row:
                _, b, until, new = row
                row, out = next(of, None), []
                if b != due:
                    raise ValueError(f"bytes from {due * size} on are missing")
                known, due = np.concatenate((known, new)), due + 1
                while start < until:
                    k = int(np.searchsorted(known, max(start + config.least, 0 if start else WINDOW + 1)))
                    end = min(int(known[k]) if k < len(known) else until, start + config.most)
                    if row and k == len(known) and start + config.most > until:
                        break  # its end may be in the next block
                    out.append((start // size, pos, start, end))
                    start, pos = end, pos + 1
                known = known[np.searchsorted(known, start) :]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([stream] * len(out), pa.string()), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], schema=walked)

    small_batches(pieces.sparkSession)
    whole = blocks(pieces.select(F.col("stream").cast("string").alias("stream"), "start_offset", "data"), size, config.most)
    ends = whole.mapInArrow(marks, "stream string, b long, until long, marks array<long>").repartition("stream").sortWithinPartitions("stream", "b").mapInArrow(walk, "stream string, b long, pos long, start long, end long")
    # A union, not a join: blocks on both sides of a join would be made twice.
    none = lambda t: F.lit(None).cast(t)
    both = whole.select("stream", "b", "base", "data", none("struct<pos: bigint, start: bigint, end: bigint>").alias("c")).union(ends.select("stream", "b", none("long"), none("binary"), F.struct("pos", "start", "end")))
    met = both.groupBy("stream", "b").agg(F.max("base").alias("base"), F.first("data", ignorenulls=True).alias("data"), F.collect_list("c").alias("cs"))
    # Chunks are cut after explode: in a lambda, each would copy its whole block first.
    each = met.select("stream", "base", "data", F.explode("cs").alias("c"))
    n = F.col("c.end") - F.col("c.start")
    cut = each.select("stream", "c.pos", F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"), n.alias("size"), F.substring("data", (F.col("c.start") - F.col("base") + 1).cast("int"), n.cast("int")).alias("blob"))
    return cut.select("stream", "pos", "start_offset", "end_offset", "size", F.sha2("blob", 256).alias("digest"), "blob")
