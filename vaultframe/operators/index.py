"""Chunk indexes: running offsets, offset and range look-ups, restoring.

Range joins are equi-joins on (stream, bucket of offsets): each interval is dealt to the buckets that it touches, the
exact predicate is checked, and a pair counts in the first bucket that both touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions import scalars as S

BUCKET = 1 << 22
#: Before each file's bytes in a payload stream, and at the stream's start.
HEADER = 16


#: Positions of a range: running sums add up ranges first and then go on within each, so that no task sorts a whole stream.
RANGE = 1 << 16


def _ranged(df: DataFrame, total: Column, found: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the range of their position, for each range the total of all before it as `found`)."""
    rows = df.withColumn("__r", F.floor(F.col("pos") / RANGE))
    before = Window.partitionBy("stream").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    of_ranges = rows.groupBy("stream", "__r").agg(total.alias("__t"))
    return rows, of_ranges.select("stream", "__r", (F.max("__t") if found == "__last" else F.sum("__t")).over(before).alias(found))


def running(df: DataFrame, value: Column, into: str) -> DataFrame:
    """df (stream, pos) with the sum of a value up to and with each row, by two levels."""
    rows, before = _ranged(df, F.sum(value), "__before")
    within = Window.partitionBy("stream", "__r").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__within", F.sum(value).over(within)).join(before, ["stream", "__r"])
    return out.select(*df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__within")).cast("long").alias(into))


def with_ends(chunks: DataFrame) -> DataFrame:
    """chunks (stream, pos, size) with running start and end offsets."""
    return running(chunks, F.col("size"), "end_offset").withColumn("start_offset", F.col("end_offset") - F.col("size"))


def with_starts(index: DataFrame) -> DataFrame:
    """An index (stream, pos, end_offset) with start offsets: the end before, 0 at first."""
    rows, before = _ranged(index, F.max("end_offset"), "__last")
    own = F.lag("end_offset").over(Window.partitionBy("stream", "__r").orderBy("pos"))
    return rows.withColumn("__own", own).join(before, ["stream", "__r"]).select(*index.columns, F.coalesce("__own", "__last", F.lit(0)).cast("long").alias("start_offset"))


def fixed_bounds(streams: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks of fixed size of streams (stream, total): the last may be shorter, an empty stream has none."""
    pos = F.explode(F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / chunk_size).cast("long"))))
    return streams.select("stream", "total", pos.alias("pos")).select("stream", "pos", (F.col("pos") * chunk_size).alias("start_offset"), F.least((F.col("pos") + 1) * chunk_size, "total").alias("end_offset"))


def payload_places(files: DataFrame) -> DataFrame:
    """Files (stream, pos, size) with their payload_offset: each is a header and its bytes, after the stream's own header."""
    return running(files, F.col("size") + HEADER, "payload_offset").withColumn("payload_offset", F.col("payload_offset") - F.col("size"))


def _bounded(index: DataFrame) -> DataFrame:
    return index if "start_offset" in index.columns else with_starts(index)


def _dealt(df: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    low, high = F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket)
    return df.filter(F.col(start) < F.col(end)).withColumn("__b", F.explode(F.sequence(low, high)))


def chunk_of(points: DataFrame, index: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The chunk that holds each point (stream, offset): the first whose end is above it; null beyond the last."""
    spans = _dealt(_bounded(index), "start_offset", "end_offset", bucket)
    at = points.withColumn("__b", F.floor(F.col("offset") / bucket))
    p, c = at.alias("p"), spans.alias("c")
    on = (F.col("p.stream") == F.col("c.stream")) & (F.col("p.__b") == F.col("c.__b")) & (F.col("c.start_offset") <= F.col("p.offset")) & (F.col("p.offset") < F.col("c.end_offset"))
    own = [F.col(f"p.{x}") for x in points.columns]
    return p.join(c, on, "left").select(*own, *[F.col(f"c.{x}") for x in spans.columns if x not in (*points.columns, "__b")])


def ranges(spans: DataFrame, index: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Overlaps of spans (stream, start, end) with chunks: chunk bounds, the overlap, and whether it is the whole chunk."""
    a = _dealt(spans, "start", "end", bucket).alias("a")
    c = _dealt(_bounded(index), "start_offset", "end_offset", bucket).alias("c")
    first = F.greatest(F.floor(F.col("a.start") / bucket), F.floor(F.col("c.start_offset") / bucket))
    on = (F.col("a.stream") == F.col("c.stream")) & (F.col("a.__b") == F.col("c.__b")) & (F.col("a.start") < F.col("c.end_offset")) & (F.col("a.end") > F.col("c.start_offset")) & (F.col("a.__b") == first)
    low, high = F.greatest("a.start", "c.start_offset"), F.least("a.end", "c.end_offset")
    extra = [F.col(f"c.{x}") for x in index.columns if x not in ("stream", "pos", "start_offset", "end_offset", *spans.columns)]
    return a.join(c, on).select(
        *[F.col(f"a.{x}") for x in spans.columns], F.col("c.pos").alias("chunk_index"), F.col("c.start_offset").alias("chunk_start"), F.col("c.end_offset").alias("chunk_end"),
        low.alias("content_start"), high.alias("content_end"), ((low == F.col("c.start_offset")) & (high == F.col("c.end_offset"))).alias("is_full_chunk"), *extra,
    )


def file_ranges(files: DataFrame, index: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Chunks that hold the content of files (stream, payload_offset, size): content begins after the header, empty files have none."""
    start = F.col("payload_offset") + HEADER
    return ranges(files.withColumn("start", start).withColumn("end", start + F.col("size")), index, bucket).drop("start", "end")


def joined(pieces: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """Bytes put together in order. A key's bytes meet in one row: for what a row can hold."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("b")))), lambda x: F.hex(x["b"]))
    return pieces.groupBy(*keys).agg(F.unhex(F.array_join(parts, "")).alias("data"))  # linear in the bytes, unlike adding one piece after the other


def restored(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each stream's bytes from its index and the chunks (digest, blob); a chunk that is missing fails."""
    got = index.join(chunks.select("digest", "blob"), "digest", "left")
    checked = got.withColumn("blob", F.coalesce("blob", F.raise_error(F.concat(F.lit("missing chunk "), "digest")).cast("binary")))
    return joined(checked, ["stream"], "pos", "blob")


def pieces(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each stream's bytes as rows (stream, start_offset, data), for streams of any length; a chunk that is missing fails."""
    got = index.select("stream", "end_offset", "digest").join(chunks.select("digest", "blob"), "digest", "left")
    data = F.coalesce("blob", F.raise_error(F.concat(F.lit("missing chunk "), "digest")).cast("binary"))
    return got.select("stream", (F.col("end_offset") - F.octet_length(data)).alias("start_offset"), data.alias("data"))


def restored_ranges(wanted: DataFrame, index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The bytes of (stream, offset, length): cut at the stream's end, empty for length 0; an offset at or beyond the end fails."""
    bounded = _bounded(index)
    total = bounded.groupBy("stream").agg(F.max("end_offset").alias("total"))
    asked = wanted.join(total, "stream", "left").withColumn("offset", F.when((F.col("length") == 0) | (F.col("offset") < F.coalesce("total", F.lit(0))), F.col("offset")).otherwise(F.raise_error(F.lit("offset beyond the end")).cast("long")))
    spans = asked.select("stream", "offset", "length", F.col("offset").alias("start"), F.least(F.col("offset") + F.col("length"), "total").alias("end"))
    got = ranges(spans, bounded).join(chunks.select("digest", "blob"), "digest", "left")
    part = F.substring(F.coalesce("blob", F.raise_error(F.lit("missing chunk")).cast("binary")), (F.col("content_start") - F.col("chunk_start") + 1).cast("int"), (F.col("content_end") - F.col("content_start")).cast("int"))
    keys = ["stream", "offset", "length"]
    bytes_of = joined(got.withColumn("part", part), keys, "chunk_index", "part")
    return asked.select(*keys).join(bytes_of, keys, "left").withColumn("data", F.coalesce("data", F.lit(b"")))


def checksum(index: DataFrame, fixed: bool = False) -> DataFrame:
    """SHA-256 of each index: of its digests in order, each after its end offset unless chunks have a fixed size."""
    entry = F.unhex("digest") if fixed else F.concat(S.le64("end_offset"), F.unhex("digest"))
    return joined(index.withColumn("e", entry), ["stream"], "pos", "e").select("stream", F.sha2("data", 256).alias("csum"))


def totals(index: DataFrame) -> DataFrame:
    """Chunks and virtual size of each index."""
    return index.groupBy("stream").agg(F.count("*").alias("chunks"), F.coalesce(F.max("end_offset"), F.lit(0)).alias("bytes"))
