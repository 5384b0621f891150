"""Change detection between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.functions import scalars as S


def changes(previous: DataFrame, current: DataFrame, key: str = "path", columns: tuple[str, ...] | None = None) -> DataFrame:
    """key and status (unchanged, changed, added, removed) of every key. By default entries are compared as a backup does; else by the given columns, null-safely."""
    a, b = previous.alias("a"), current.alias("b")
    same = S.entry_matches("a", "b", tuple(c for c in S.METADATA if c in previous.columns)) if columns is None else S.equal("a", "b", columns)
    both = a.withColumn("__a", F.lit(1)).alias("a").join(b.withColumn("__b", F.lit(1)).alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    status = F.when(F.col("a.__a").isNull(), "added").when(F.col("b.__b").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def to_read(previous: DataFrame, current: DataFrame, key: str = "path", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Entries of the current snapshot whose content must be read again."""
    return current.join(changes(previous, current, key, columns).filter(F.col("status").isin("changed", "added")).select(key), key, "left_semi")
