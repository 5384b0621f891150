"""Look-up tables of directories: names by unsigned hash, laid out as an implicit search tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions.codecs import name_hash


def layout(n: int) -> list[int]:
    """For each place of a complete search tree in breadth-first order, the rank of the item there.

    Ranks are what an in-order walk of the heap-shaped tree meets in turn.
    """
    out, rank, stack, node = [0] * n, 0, [], 0
    while stack or node < n:
        while node < n:
            stack.append(node)
            node = 2 * node + 1
        node = stack.pop()
        out[node] = rank
        rank += 1
        node = 2 * node + 2
    return out


def place(rank: Column, n: Column) -> Column:
    """The inverse of layout in the JVM: where in breadth-first order the item of a rank (from 0) stands among n.

    Were the lowest level full, every second item were on it; those beyond its end are skipped. An item's level is then
    told by the trailing zeros of its number, its place in the level by what is above them.
    """
    depth = F.length(F.bin(n)) - 1
    power = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e)
    last = n - (power(depth) - 1)
    number = F.when(rank + 1 <= 2 * last, rank + 1).otherwise(2 * (rank + 1 - last))
    zeros = F.bit_count(number.bitwiseAND(-number) - 1)
    level = depth - zeros
    return power(level) - 1 + F.call_function("shiftright", number, zeros + 1)


def laid_out(entries: DataFrame, order: Column) -> DataFrame:
    """Entries (parent, name) with their place in the look-up table of their directory, which is searched by `order`."""
    of_parent = Window.partitionBy("parent")
    numbered = entries.withColumns({"__r": F.row_number().over(of_parent.orderBy(order, "name")).cast("long") - 1, "__n": F.count("*").over(of_parent)})
    return numbered.withColumn("place", place(F.col("__r"), F.col("__n"))).drop("__r", "__n")


def ranked(entries: DataFrame) -> DataFrame:
    """Entries (parent, name) with their hash and its unsigned rank in the directory."""
    h = entries.withColumn("hash", name_hash("name"))
    w = Window.partitionBy("parent").orderBy(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), "name")
    return h.withColumn("rank", F.row_number().over(w) - 1)
