"""Catalogs of entries: walks, listings, look-ups and paging, all as joins and filters on paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions import scalars as S


def flat(entries: DataFrame) -> DataFrame:
    """path, kind, file_size and parent_path of every entry; content is never read."""
    return entries.select("path", "kind", F.when(F.col("kind") == "file", F.col("size")).otherwise(0).cast("long").alias("file_size"), S.parent_of("path").alias("parent_path"))


def with_directories(files: DataFrame) -> DataFrame:
    """files (path, kind, size) and a row for every directory above them."""
    above = files.select(F.explode(S.ancestors("path")).alias("path")).distinct()
    above = above.join(files.select("path"), "path", "left_anti")
    return files.select("path", "kind", "size").unionByName(above.select("path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size")))


def order(path: str = "path") -> Column:
    """Pre-order: a directory before what it holds, names in code-point order."""
    return S.components_of(path)


def walk(entries: DataFrame, root: str = "/", kinds: tuple[str, ...] | None = None, pruned: DataFrame | None = None, content: bool = False) -> DataFrame:
    """Entries of a subtree, of some kinds only if given; subtrees of the pruned paths are left out. A filter of kinds does not stop the descent."""
    out = entries.filter(S.below("path", root))
    if kinds is not None:
        out = out.filter(F.col("kind").isin(*kinds))
    if pruned is not None:
        out = without_subtrees(out, pruned)
    return out if content or "content" not in out.columns else out.drop("content")


def without_subtrees(entries: DataFrame, pruned: DataFrame) -> DataFrame:
    """Leaves out the subtrees of pruned (path): an anti-join on each entry's own path and those above it."""
    each = entries.select("path", F.explode(F.array_append(S.ancestors("path"), F.col("path"))).alias("above"))
    gone = each.join(pruned.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
    return entries.join(gone, "path", "left_anti")


def skip(entries: DataFrame, n: int) -> DataFrame:
    """All but the first n entries visited."""
    return entries.orderBy(order()).offset(n)


def listing(entries: DataFrame, directory: str) -> DataFrame:
    return entries.filter(S.parent_of("path") == directory)


def children(entries: DataFrame) -> DataFrame:
    """For each directory: how many entries it holds, and their names, kinds and sizes."""
    return entries.filter(F.col("path") != "/").groupBy(S.parent_of("path").alias("parent")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(S.base_name("path").alias("name"), "kind", "size"))).alias("entries"))


def look_up(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for each asked path (pos, path) in its place; nulls where there is no such entry."""
    return paths.join(entries, "path", "left")


def found(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """As look_up, but a path without an entry fails."""
    own = entries.withColumn("__there", F.lit(True))
    return look_up(own, paths).withColumn("path", F.when(F.col("__there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no such entry: "), "path")))).drop("__there")


def children_named(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (parent, name) the entry of that name in that directory; nulls where there is none."""
    return asked.join(entries.withColumns({"parent": S.parent_of("path"), "name": S.base_name("path")}), ["parent", "name"], "left")


def at_offset(entries: DataFrame, offsets: DataFrame, archive: list[str] | None = None) -> DataFrame:
    """For each file_offset (of an archive, if its key columns are given) the entry that begins there; an offset inside an entry finds nothing."""
    return offsets.join(entries, [*(archive or []), "file_offset"], "left")


def accessible(inodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked inode with whether it exists: what exists may be read, whatever mask is asked for."""
    return asked.join(inodes.select("inode", F.lit(True).alias("__there")).distinct(), "inode", "left").withColumn("accessible", F.coalesce("__there", F.lit(False))).drop("__there")


def nth(entries: DataFrame, key: str, n: int, by: str) -> DataFrame:
    """The n-th (from 0) entry of each key."""
    return entries.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(by))).filter(F.col("__k") == n + 1).drop("__k")


def page(entries: DataFrame, directory: str, offset: int, limit: int) -> DataFrame:
    """A page of a directory: its children by name, then "." and ".."; position counts from 1."""
    spark = entries.sparkSession
    own = listing(entries, directory).select(S.base_name("path").alias("name"), "kind", F.lit(0).alias("last"))
    dots = spark.createDataFrame([(".", "directory", 1), ("..", "directory", 2)], "name string, kind string, last int")
    rows = own.union(dots).orderBy("last", "name").limit(offset + limit)
    numbered = rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("last", "name")))
    return numbered.filter(F.col("position") > offset).select(F.col("position").cast("long").alias("position"), "name", "kind")


def subtree_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes below every directory."""
    return files.filter(F.col("kind") == "file").select(F.explode(S.ancestors("path")).alias("path"), "size").groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def file_system_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.floor(F.coalesce(F.sum("size"), F.lit(0)) / 512).cast("long").alias("blocks"))


def directory_index(entries: DataFrame, index: DataFrame, stream: str) -> DataFrame:
    """Where each directory's content lies: chunk and place in it."""
    from vaultframe.operators.index import chunk_of

    points = entries.filter(F.col("kind") == "directory").select(F.lit(stream).alias("stream"), "path", F.col("content_offset").alias("offset"))
    return chunk_of(points, index).select("path", F.col("pos").alias("chunk"), (F.col("offset") - F.col("start_offset")).alias("place"))


def hard_links(entries: DataFrame) -> DataFrame:
    """Each hard link with the file that it names."""
    links = entries.filter(F.col("kind") == "hardlink").select("path", F.col("link_target").alias("target"))
    files = entries.filter(F.col("kind") == "file").select(F.col("path").alias("target"), "size", "mode")
    return links.join(files, "target", "left").select("path", "target", "size", "mode")


def result(entries: DataFrame) -> DataFrame:
    """Files, directories (the root not counted) and bytes of a backup."""
    kind = F.col("kind")
    return entries.agg(F.count_if(kind == "file").alias("files"), F.count_if((kind == "directory") & (F.col("path") != "/")).alias("directories"), F.coalesce(F.sum(F.when(kind == "file", F.col("size"))), F.lit(0)).alias("bytes"))


def tree(adjacency: DataFrame) -> DataFrame:
    """Depth and path of rows (id, parent_id, name) by a recursive query; roots have no parent."""
    spark = adjacency.sparkSession
    adjacency.createOrReplaceTempView("__adjacency")
    return spark.sql("WITH RECURSIVE t(id, path, depth) AS (SELECT id, name, 0 FROM __adjacency WHERE parent_id IS NULL UNION ALL SELECT a.id, concat(t.path, '/', a.name), t.depth + 1 FROM __adjacency a JOIN t ON a.parent_id = t.id) SELECT * FROM t")
