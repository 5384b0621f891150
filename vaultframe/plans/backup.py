"""Backups as plans over tables: full, incremental by metadata, and whole archives as chunked streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.operators import catalog, chunking, dedup, diff, index
from vaultframe.sources import archive


@dataclass(frozen=True)
class Backup:
    """entries without content, index (stream, pos, end_offset, digest) and the chunks that were new to the store."""

    entries: DataFrame
    index: DataFrame
    new_chunks: DataFrame

    def result(self) -> DataFrame:
        return catalog.result(self.entries)

    def manifest_files(self) -> DataFrame:
        """What the manifest lists: a file for each stream, with its size and the checksum of its index."""
        return index.totals(self.index).join(index.checksum(self.index), "stream").select(F.concat("stream", F.lit(".didx")).alias("filename"), F.col("bytes").alias("size"), "csum")


def full(entries: DataFrame, config: chunking.Config, store: DataFrame | None = None) -> Backup:
    """Every file's content is a stream of its own, named by its path, and is chunked on its own."""
    streams = entries.filter(F.col("kind") == "file").select(F.col("path").alias("stream"), F.col("content").alias("data"))
    chunks = chunking.content_defined(streams, config)
    new = dedup.to_insert(chunks, store) if store is not None else chunks.dropDuplicates(["digest"])
    return Backup(catalog.with_directories(entries.drop("content")), chunks.select("stream", "pos", "end_offset", "digest"), new.select("digest", "size", "blob"))


def incremental(entries: DataFrame, previous: DataFrame, previous_index: DataFrame, config: chunking.Config, store: DataFrame, columns: tuple[str, ...] | None = None) -> Backup:
    """Files whose metadata did not change keep their part of the previous index; only others are read and chunked."""
    light = entries.drop("content")
    changed = diff.to_read(previous, light, columns=columns).select("path")
    read = full(entries.join(changed, "path", "left_semi"), config, store)
    kept = previous_index.join(light.filter(F.col("kind") == "file").select(F.col("path").alias("stream")), "stream", "left_semi").join(changed.select(F.col("path").alias("stream")), "stream", "left_anti")
    return Backup(catalog.with_directories(light), read.index.unionByName(kept), read.new_chunks)


#: Streams of an archive: the only one, or, split, that of metadata and that of file bytes.
WHOLE, META, PAYLOAD = ".pxar", ".mpxar", ".ppxar"


def archived(entries: DataFrame, key: str, config: chunking.Config, split: bool = False, store: DataFrame | None = None) -> Backup:
    """Each archive of entries (by a key column) as one chunked stream, or as two with file bytes apart, so that metadata is read without them. Chunks that the store has are not written again."""
    made = archive.pieces(entries, key, split)
    suffix = F.when(F.col("payload"), PAYLOAD).otherwise(META) if split else F.lit(WHOLE)
    chunks = chunking.content_defined_pieces(made.select(F.concat(key, suffix).alias("stream"), "start_offset", "data"), config)
    new = dedup.to_insert(chunks, store) if store is not None else chunks.dropDuplicates(["digest"])
    return Backup(entries.drop("content"), chunks.select("stream", "pos", "end_offset", "digest"), new.select("digest", "size", "blob"))


def opened(backup_index: DataFrame, chunks: DataFrame, key: str, content: bool = True, split: bool = True) -> DataFrame:
    """Entries of chunked archives, split or not, from their index and the chunks. Without content, or where none is said to be split, no chunk of a payload stream is read."""
    name = F.regexp_replace("stream", r"\.[mp]?pxar$", "").alias(key)
    is_payload = F.col("stream").endswith(PAYLOAD)
    part = lambda rows: index.pieces(rows, chunks).select(name, "start_offset", "data")
    main = archive.entries_of_pieces(part(backup_index.filter(~is_payload)), key, content)
    return archive.with_payloads(main, part(backup_index.filter(is_payload)), key) if content and split else main
