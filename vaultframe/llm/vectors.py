"""What the two searches over vectors share.

Equal vectors are searched once: a distinct vector is named by its smallest id and carries the KEEP smallest ids that
have it, which is all that ties to smaller ids can ask for. Queries that are equal share one search, too. Rows of equal id
and vector count once, as neighbours and as queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours asked for, and one more, as a query may be among its own.
TOP = 5
KEEP = TOP + 1
FOUND = "query long, candidate long, ids array<bigint>, score {}"


def distinct(vectors: DataFrame) -> DataFrame:
    """(id, ids, dim, vec) of the distinct vectors of (vec_id, vec)."""
    few = vectors.withColumn("k", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("k") <= KEEP)
    return few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", F.size("vec").alias("dim"), "vec")


def asked(vectors: DataFrame, all_distinct: DataFrame, query: Column) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors that are queries, the query ids of each)."""
    rows = vectors.filter(query)
    once = rows.groupBy("vec").agg(F.count("*").alias("n")).join(all_distinct, "vec").select("id", "dim", "vec")
    names = rows.join(once, "vec").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")).distinct()
    return once, names


def sizes(df: DataFrame) -> dict[int, int]:
    """How many rows each dimension has."""
    return {r.dim: r.n for r in df.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each dimension


def by_dimension(df: DataFrame, most: int) -> tuple[Column, int]:
    """(parts for each dimension so that none has much over `most` rows, the largest number of parts)."""
    parts = {d: max(1, math.ceil(n / most)) for d, n in sizes(df).items()}
    return F.coalesce(*(F.when(F.col("dim") == d, k) for d, k in parts.items()), F.lit(1)).cast("int"), max(parts.values(), default=1)


def blocks(asked: DataFrame, data: DataFrame, cuts: tuple[Column, int], own_cuts: tuple[Column, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key (cut, asked_cut) of blocks: each part of the queries meets each part of the data, and no block is large on either side."""
    data = data.withColumn("cut", F.pmod(F.xxhash64("id"), cuts[0]).cast("int"))
    asked = asked.withColumn("asked_cut", F.pmod(F.xxhash64("id"), own_cuts[0]).cast("int"))
    asked = asked.withColumn("cut", F.explode(F.sequence(F.lit(0), cuts[0] - 1)) if cuts[1] > 1 else F.lit(0))
    return asked, data.withColumn("asked_cut", F.explode(F.sequence(F.lit(0), own_cuts[0] - 1)) if own_cuts[1] > 1 else F.lit(0))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """Vectors as a matrix, from lists or from bytes (see packed)."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_binary(flat.type):
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)
    begin = np.frombuffer(flat.buffers()[1], np.int32, 1, 4 * flat.offset)[0]
    return np.frombuffer(flat.buffers()[2], kind, len(flat) * dim, int(begin)).reshape(len(flat), dim)


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of eight-byte numbers as bytes: the JVM copies them whole."""
    at = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def best(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the KEEP highest scores, ties to smaller ids."""
    if len(scores) > KEEP:
        least = np.partition(scores, len(scores) - KEEP)[len(scores) - KEEP]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:KEEP]


def answers(found: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score from what was found for the distinct queries in parts of the data."""
    once = found.groupBy("query", "candidate").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    near = once.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))).filter(F.col("k") <= KEEP)
    each = near.select("query", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= KEEP)
    lists = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("found"))
    own = names.join(lists, "query").withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, TOP))
    return own.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
