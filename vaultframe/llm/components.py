"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is joins and partial aggregates over the links; the driver sees only whether they are stars by now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import written


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or is one, never both; so each component is a star around its smallest node."""
    end = lambda c, out: edges.select(F.col(c).alias("x"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    ends = end("u", 1).union(end("v", 0)).groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.filter("out > 1 or out = 1 and into = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is named by its smallest node."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")  # no more rows than edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        edges = written(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
