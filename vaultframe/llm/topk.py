"""Exact top-k by integer inner product with pivot-table elimination.

Components x become floor(256 * x). `pivots` vectors, the first of the distinct ones by a hash of their id, are fixed;
the distances of every vector to all of them are computed once and travel with it. For a query and a block of data the
triangle inequality gives a lower bound of each distance (the largest difference over the pivots), hence an upper bound
of each inner product; candidates are evaluated in the order of that bound until it is below the k-th score. The k-th
score among the pivots themselves, known from the table, is a first threshold, so a block whose bounds are all below it is skipped whole. Every query
meets every block of about `block` vectors; blocks' best are merged.

Null vectors, and those with null or non-finite components, take no part; vectors meet only vectors of their dimension.
Rows with null ids take no part. Repeated vectors tie, and smaller ids come first. Scores beyond a long stop at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.llm import vectors
from vaultframe.llm.common import written

#: Below this squared norm all sums of products are exact in double precision.
EXACT = 2.0**52


def _table(pivots: dict[int, np.ndarray]):
    """Appends each vector's distances to the pivots of its dimension; both as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                x = vectors.matrix(rows.column("vec"), dim)
                wide = x.astype(np.float64)
                away = np.stack([np.sqrt(((wide - p) ** 2).sum(1)) for p in pivots[dim]], 1)
                yield rows.set_column(rows.schema.get_field_index("vec"), "vec", vectors.packed(x)).append_column(pa.field("away", pa.binary()), vectors.packed(away))

    return run


def threshold(q: np.ndarray, away: np.ndarray, norms: np.ndarray) -> float:
    """A bound that the KEEP-th best score is not below: that among the pivots, less what rounding may add."""
    if len(norms) < vectors.KEEP:
        return -np.inf
    own = float(np.dot(q, q))
    score = np.sort((own + norms - away * away) / 2)[-vectors.KEEP]
    return score - 1 - 1e-9 * (own + norms.max())


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ q).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(a * b for a, b in zip(q, row, strict=True)))) for row in x.tolist()], dtype=np.int64)


def search_block(q: np.ndarray, q_away: np.ndarray, x: np.ndarray, x_away: np.ndarray, norms: np.ndarray, ids: np.ndarray, exact: bool, chunk: int = 256, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, evaluated) of the best of a block."""
    gap = np.abs(x_away - q_away).max(1)
    gap = np.maximum(0, gap * (1 - 1e-9) - 1e-6)
    own = float(np.dot(q.astype(np.float64), q.astype(np.float64)))
    bound = (own + norms - gap * gap) / 2
    bound += 1e-9 * np.abs(bound) + 1e-6 * (own + norms) / (1 + own + norms) + 1e-12 * (own + norms)
    order = np.argsort(-bound, kind="stable")
    at, scores, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    operand = q.astype(np.float64) if exact else q.tolist()
    while done < len(order):
        if bound[order[done]] < max(least, scores[-1] if len(scores) == vectors.KEEP else -np.inf):
            break
        some = order[done : done + chunk]
        done, chunk = done + len(some), 2 * chunk
        at, scores = np.concatenate((at, some)), np.concatenate((scores, _products(operand, x[some], exact)))
        best = vectors.best(scores, ids[at]) if len(scores) else np.zeros(0, np.int64)
        at, scores = at[best], scores[best]
    return at, scores, done


def _searched(pivots: dict[int, np.ndarray]):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
        return _of_block(queries, rows, key[1].as_py(), pivots[key[1].as_py()])

    return run


def _of_block(queries: pa.Table, rows: pa.Table, dim: int, pivots: np.ndarray) -> pa.Table:
    out: list[list] = [[], [], [], []]
    if len(queries) and len(rows):
        q, x = (vectors.matrix(t.column("vec"), dim, np.int64) for t in (queries, rows))
        away = [vectors.matrix(t.column("away"), len(pivots)) for t in (queries, rows)]
        of_pivots = (pivots * pivots).sum(1)
        wide = x.astype(np.float64)
        norms = (wide * wide).sum(1)
        exact = max(norms.max(), (q.astype(np.float64) ** 2).sum(1).max()) < EXACT
        ids, lists = rows.column("id").to_numpy(), rows.column("ids").to_pylist()
        for k, name in enumerate(queries.column("id").to_pylist()):
            at, scores, _ = search_block(q[k], away[0][k], wide if exact else x, away[1], norms, ids, exact, least=threshold(q[k].astype(np.float64), away[0][k], of_pivots))
            out[0] += [name] * len(at)
            out[1] += ids[at].tolist()
            out[2] += [lists[i] for i in at]
            out[3] += scores.tolist()
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int64())], ["query", "candidate", "ids", "score"])


def search(df: DataFrame, query: Column, pivots: int = 64, block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the highest inner products for each row of df that fulfils `query` (on vec_id)."""
    sound = F.col("real").isNotNull() & F.forall("real", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("real")).filter(sound).filter("vec_id is not null")
    rows = rows.filter(F.size("real") > 0).select("vec_id", F.transform("real", lambda x: F.floor(x * 256).cast("long")).alias("vec"))
    reps = written(vectors.distinct(rows))
    once, names = vectors.asked(rows, reps, query)
    hashed = reps.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))).filter(F.col("k") <= pivots)
    chosen: dict[int, list] = {}
    for r in hashed.select("dim", "vec", "k").orderBy("dim", "k").collect():  # `pivots` rows for each dimension
        chosen.setdefault(r.dim, []).append(r.vec)
    table = {d: np.array(v, np.float64) for d, v in chosen.items()}
    kind = "dim int, vec binary, away binary"
    data = reps.select("id", "ids", "dim", "vec").mapInArrow(_table(table), f"id long, ids array<bigint>, {kind}")
    asked = once.select("id", "dim", "vec").mapInArrow(_table(table), f"id long, {kind}")
    asked, data = vectors.blocks(asked, data, vectors.by_dimension(reps, block), vectors.by_dimension(once, block))
    keys = ["cut", "dim", "asked_cut"]
    found = asked.groupBy(keys).cogroup(data.groupBy(keys)).applyInArrow(_searched(table), vectors.FOUND.format("long"))
    return vectors.answers(found, names)
