"""Copies between archives: mappings of subtrees, merges and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions import scalars as S

DIRECTORY_MODE = 0o040755


def mapped(entries: DataFrame, src: str, dst: str) -> DataFrame:
    """The subtree of src below dst."""
    return entries.filter(S.below("path", src)).withColumn("path", S.rewritten("path", src, dst))


def merged(parts: list[DataFrame], on_conflict: str = "keep_all") -> DataFrame:
    """Parts (path, kind, size, ...) as one archive with every directory above its entries; of a path that comes again all, the first or the last part's entry stays."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(n))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if on_conflict != "keep_all":
        by = F.col("__part").asc() if on_conflict == "first" else F.col("__part").desc()
        out = out.withColumn("__k", F.row_number().over(Window.partitionBy("path").orderBy(by))).filter("__k = 1").drop("__k")
    out = out.drop("__part")
    above = out.select(F.explode(S.ancestors("path")).alias("path")).distinct().join(out.select("path"), "path", "left_anti")
    above = above.withColumns({"kind": F.lit("directory"), "size": F.lit(0).cast("long")})
    if "mode" in out.columns:
        above = above.withColumn("mode", F.lit(DIRECTORY_MODE).cast("long"))
    return out.unionByName(above, allowMissingColumns=True)


def copied(entries: DataFrame, mappings: list[tuple[str, str]], on_conflict: str = "keep_all") -> DataFrame:
    return merged([mapped(entries, s, d) for s, d in mappings], on_conflict)
