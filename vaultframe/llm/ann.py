"""Approximate nearest neighbours by cross-polytope hashing.

Each of `tables` hashes concatenates pseudo-rotations (three rounds of random signs and a fast Hadamard transform, over the
next power of two of the dimension), each of which assigns a unit vector to the nearest signed axis. There are as many
rotations, the last over fewer axes, as make buckets of about `per` vectors, so buckets grow with the table in number and
not in size. A vector is indexed once in each table; a query
looks into the buckets that it comes nearest to, in the sum of the squared distances to their axes, the more of them the more there are (`probes` of the signed
axes of one rotation), and all that lies there is ranked by exact cosine
in double precision. A query that finds fewer than asked for this way, though there are more of its dimension, meets all of
them in a second, exact search. Buckets of more than `part` vectors or queries are counted first and cut into parts, so that none is too large for a task.

Null and zero vectors, and those with null or non-finite components, take no part; vectors meet only vectors of their
dimension. Rows with null ids take no part. Repeated vectors tie, and smaller ids come first; a repeated id counts once
for each vector that it has. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import vectors
from vaultframe.llm.common import written


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """x, padded to a power of two, under the pseudo-rotation of a table; not normalised."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, size))
    y[:, :d] = x
    rng = np.random.default_rng([seed, table, size])
    for _ in range(3):
        y *= rng.choice((-1.0, 1.0), size)
        h = 1
        while h < size:
            y = y.reshape(n, -1, 2, h)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, size)
            h *= 2
        y /= np.sqrt(size)
    return y


def shape(n: int, dim: int, per: int) -> list[int]:
    """Axes of the rotations that are concatenated for n vectors."""
    size = 1 << max(0, dim - 1).bit_length()
    out, rest = [size], n / (2 * size * per)
    while rest > 1.5:
        out.append(min(size, 1 << max(0, int(rest / 2).bit_length() - 1)))
        rest /= 2 * out[-1]
    return out


def probes_for(axes: list[int], probes: int) -> int:
    """Buckets that a query looks into: they grow more slowly than all buckets."""
    return max(1, round(probes * float(np.prod([2.0 * d for d in axes[1:]])) ** 0.6))


def codes(x: np.ndarray, table: int, axes: list[int], probes: int, seed: int) -> np.ndarray:
    """The nearest buckets of each row, nearest first: its signed axes (2 * axis, + 1 if negative) in each rotation as one number."""
    out = []
    for k in range(0, max(len(x), 1), 256):
        code = away = None
        for r, d in enumerate(axes):
            y = rotated(x[k : k + 256], table if r == 0 else (r << 20) + table, seed)[:, :d]
            signed = np.stack((y, -y), 2).reshape(len(y), 2 * d)
            gap = (signed.max(1, keepdims=True) - signed) ** 2
            if code is None:
                away, code = gap, np.broadcast_to(np.arange(2 * d), gap.shape)
            else:
                away = (away[:, :, None] + gap[:, None, :]).reshape(len(y), -1)
                code = (code[:, :, None] * (2 * d) + np.arange(2 * d)).reshape(len(y), -1)
            if away.shape[1] > probes:
                near = np.argpartition(away, probes - 1, axis=1)[:, :probes]
                away, code = np.take_along_axis(away, near, 1), np.take_along_axis(code, near, 1)
        out.append(np.take_along_axis(code, np.argsort(away, axis=1, kind="stable"), 1))
    return np.concatenate(out)


def _hashed(shapes: dict[int, list[int]], tables: int, probes: int | None, seed: int, counted: bool = False):
    """Rows with their buckets (one in each table, or, with probes, all that are looked into) and the vector as bytes; counted: only how many rows of a batch are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                x = vectors.matrix(rows.column("vec"), dim)
                rows = rows.set_column(rows.schema.get_field_index("vec"), "vec", vectors.packed(x))
                for t in range(tables):
                    code = codes(x, t, shapes[dim], 1 if probes is None else probes_for(shapes[dim], probes), seed)
                    if counted:
                        found, n = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), v), k) for v, k in ((t, pa.int32()), (dim, pa.int32()))] + [pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["bucket_table", "dim", "code", "n"])
                        continue
                    again = rows if probes is None else rows.take(pa.array(np.repeat(np.arange(len(x)), code.shape[1])))
                    yield again.append_column(pa.field("bucket_table", pa.int32()), pa.array(np.full(code.size, t), pa.int32())).append_column(pa.field("code", pa.int64()), pa.array(code.ravel(), pa.int64()))

    return run


def _ranked(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
    dim = key[2].as_py()
    out: list[list] = [[], [], [], []]
    if len(queries) and len(rows):
        q, x = vectors.matrix(queries.column("vec"), dim), vectors.matrix(rows.column("vec"), dim)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        ids, lists, names = rows.column("id").to_numpy(), rows.column("ids").to_pylist(), queries.column("id").to_pylist()
        for k in range(0, len(q), 256):
            part = q[k : k + 256]
            for name, s in zip(names[k : k + 256], (part / np.sqrt((part * part).sum(1))[:, None]) @ x.T, strict=True):
                at = vectors.best(s, ids)
                out[0] += [name] * len(at)
                out[1] += ids[at].tolist()
                out[2] += [lists[i] for i in at]
                out[3] += np.clip(s[at], -1, 1).tolist()
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.float64())], ["query", "candidate", "ids", "score"])


def _cut(rows: DataFrame, crowded: DataFrame, other: DataFrame, cut: str, other_cut: str) -> DataFrame:
    """One side of the buckets with the key (cut, other_cut): rows of its crowded buckets are dealt to parts, and are there for each part of the other side's."""
    for heavy, name in ((crowded, cut), (other, other_cut)):
        n = heavy.count()
        heavy = heavy.withColumnRenamed("parts", name)
        rows = rows.join(F.broadcast(heavy) if n <= 1 << 16 else heavy, KEYS, "left").withColumn(name, F.coalesce(name, F.lit(1))) if n else rows.withColumn(name, F.lit(1))
    return rows.withColumn(cut, F.pmod(F.xxhash64("id"), cut).cast("int")).withColumn(other_cut, F.explode(F.sequence(F.lit(0), F.col(other_cut) - 1)))


KEYS = ["bucket_table", "code", "dim"]


def search(df: DataFrame, query: Column, tables: int = 10, probes: int = 8, per: int = 100, part: int = 4096, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found for each row of df that fulfils `query` (on vec_id)."""
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).filter(sound).filter("vec_id is not null").filter(F.size("vec") > 0)
    # Scaled by the largest component, so that squares neither overflow nor vanish; cosines stay as they are.
    reps = written(vectors.distinct(rows))
    once, names = vectors.asked(rows, reps, query)
    scaled = F.transform("vec", lambda x: x / F.when(F.array_max(F.transform("vec", F.abs)).between(1e-100, 1e100), 1.0).otherwise(F.array_max(F.transform("vec", F.abs))))
    shapes = {dim: shape(n, dim, per) for dim, n in vectors.sizes(reps).items()}
    own, asked = reps.select("id", "ids", "dim", scaled.alias("vec")), once.select("id", "dim", scaled.alias("vec"))
    crowded = [
        written(side.mapInArrow(_hashed(shapes, tables, looked, seed, counted=True), "bucket_table int, dim int, code long, n long").groupBy(KEYS).agg(F.sum("n").alias("n")).filter(F.col("n") > part).select(*KEYS, F.ceil(F.col("n") / part).cast("int").alias("parts")))
        for side, looked in ((own, None), (asked, probes))
    ]
    kind = "dim int, vec binary, bucket_table int, code long"
    data = _cut(own.mapInArrow(_hashed(shapes, tables, None, seed), f"id long, ids array<bigint>, {kind}"), *crowded, "cut", "asked_cut")
    probe = _cut(asked.mapInArrow(_hashed(shapes, tables, probes, seed), f"id long, {kind}"), *crowded[::-1], "asked_cut", "cut")
    keys = [*KEYS, "cut", "asked_cut"]
    found = written(probe.groupBy(keys).cogroup(data.groupBy(keys)).applyInArrow(_ranked, vectors.FOUND.format("double")))
    have = found.groupBy("query", "candidate").agg(F.max(F.size("ids")).alias("n")).groupBy("query").agg(F.sum("n").alias("have"))
    there = reps.groupBy("dim").agg(F.sum(F.size("ids")).alias("there"))  # one row for each dimension
    few = once.join(F.broadcast(there), "dim").join(have, F.col("id") == F.col("query"), "left")
    few = written(few.filter(F.coalesce("have", F.lit(0)) < F.least("there", F.lit(vectors.KEEP))).select("id", "dim", scaled.alias("vec")))
    if few.isEmpty():
        return vectors.answers(found, names)
    asked, data = vectors.blocks(few, reps.select("id", "ids", "dim", scaled.alias("vec")), vectors.by_dimension(reps, part), vectors.by_dimension(few, part))
    keys = ["cut", "asked_cut", "dim"]
    more = asked.groupBy(keys).cogroup(data.groupBy(keys)).applyInArrow(_ranked, vectors.FOUND.format("double"))
    return vectors.answers(found.union(more), names)
