"""Mixing sources to target weights.

The words of a source's documents, in the order of doc_id, are packed into blocks of `block` words. A source's target is
its share of `share` times all words by weight, stopped at `most` times its own words, the excess shared again by
weight. Slots of the mix are dealt to output shards: each shard draws multinomial counts of sources from what each
source has still to give, so that all shards together take every target exactly. The j-th slot of a source is block
P(j mod n) of its n blocks in pass j div n, P being a pseudorandom permutation of that source and pass (a Feistel
network with cycle walking). Slots and the blocks' documents meet in a join by (source, block).

A source is one value of the source column; null is a source of its own, last in the order. Null and empty texts have no
words and are never taken; a source without words has target 0; repeated rows are documents of their own. An empty table
gives no rows. Other columns are kept by neither table, so their names cannot clash. Words of a hot source spread over
buckets of its documents; no window or join key holds a whole source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vaultframe.llm.common import WORD, tidy, written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: The table of sources, a row each, is held by the driver and by each task that draws slots; more of them are refused (see the README).
MOST_SOURCES = 1_000_000
_SLOTS = "shard long, slot int, source_no int, pass int, block long, take int"
_WORDS = re.compile(WORD)
_ARROW = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source_no", pa.int32()), ("pass", pa.int32()), ("block", pa.int64()), ("take", pa.int32())])


@dataclass(frozen=True)
class Plan:
    """What the driver knows of each source, in their order."""

    sources: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    block: int
    seed: int

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.sizes // self.block)


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares of `share` times all sizes by weight, stopped at `most` times each size; what is cut off is shared again until none is above."""
    total, stopped = share * sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(most * n for n, s in zip(sizes, stopped, strict=True) if s)
        open_weight = sum(w for w, s in zip(weights, stopped, strict=True) if not s)
        out = [most * n if s else left * w / open_weight for n, w, s in zip(sizes, weights, stopped, strict=True)]
        over = [not s and x > most * n for n, x, s in zip(sizes, out, stopped, strict=True)]
        if not any(over):
            return out
        stopped = [a or b for a, b in zip(stopped, over, strict=True)]


def _round(x: np.ndarray, key: int, r: int, mask: np.uint64) -> np.ndarray:
    h = (x + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
    return h >> np.uint64(40) & mask if mask < 1 << 24 else (h ^ (h >> np.uint64(32))) & mask


def permuted(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) sends each x (or, back, what it sends there): four Feistel rounds over an even number of bits, walked until below n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in reversed(range(4)) if back else range(4):
            if back:
                left, right = right ^ _round(left, key, r, mask), left
            else:
                left, right = right, left ^ _round(right, key, r, mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(plan: Plan, source: int, turn: int) -> int:
    return (plan.seed * 1_000_003 + source) * 8191 + turn


def needs(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source, and the words to leave out of its last slot, so that the words taken are the floor of its target."""
    slots, spare = [], []
    for k, (size, n) in enumerate(zip(plan.sizes.tolist(), plan.blocks.tolist(), strict=True)):
        passes, rest = divmod(int(plan.targets[k]), size) if size else (0, 0)
        j = have = 0
        if rest:
            short = int(permuted(np.array([n - 1]), n, _key(plan, k, passes), back=True)[0])  # where the last block, which may be short, comes
            missing = n * plan.block - size
            j = -(-rest // plan.block)
            j += j * plan.block - missing * (short < j) < rest
            have = j * plan.block - missing * (short < j) - rest
        slots.append(passes * n + j)
        spare.append(have)
    return np.array(slots, np.int64), np.array(spare, np.int64)


def _draw(rng: np.random.Generator, slots: int, left: np.ndarray) -> np.ndarray:
    """Multinomial counts of sources for a number of slots, by what is left of each source and never above it."""
    out = np.zeros(len(left), np.int64)
    while missing := slots - int(out.sum()):
        rest = left - out
        out += np.minimum(rng.multinomial(missing, rest / rest.sum()), rest)
    return out


def _dealt(plan: Plan, slots: np.ndarray, spare: np.ndarray, shard_slots: int, groups: list[tuple[int, int, np.ndarray, np.ndarray]]):
    """Rows of slots of a group of shards: draws each shard's counts from the group's, which the driver has drawn in the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                first, total, counts, begun = groups[g]
                rng, left, begun, shard = np.random.default_rng([plan.seed, 1, g]), counts.copy(), begun.copy(), first
                while total:
                    n = min(shard_slots, total)
                    drawn = _draw(rng, n, left)
                    source = rng.permutation(np.repeat(np.arange(len(drawn)), drawn))
                    j, turn, block, take = (np.zeros(n, np.int64) for _ in range(4))
                    for k in np.flatnonzero(drawn):
                        at = np.flatnonzero(source == k)
                        blocks = int(plan.blocks[k])
                        j[at] = begun[k] + np.arange(drawn[k])
                        turn[at] = j[at] // blocks
                        for t in np.unique(turn[at]):
                            own = at[turn[at] == t]
                            block[own] = permuted(j[own] % blocks, blocks, _key(plan, int(k), int(t)))
                        take[at] = np.minimum(plan.block, plan.sizes[k] - block[at] * plan.block) - spare[k] * (j[at] == slots[k] - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(source, pa.int32()), pa.array(turn, pa.int32()), pa.array(block, pa.int64()), pa.array(take, pa.int32())], schema=_ARROW)
                    left, begun, total, shard = left - drawn, begun + drawn, total - n, shard + 1

    return run


def slots_of(spark, plan: Plan, shard_slots: int) -> DataFrame:
    """One row for each slot: the shard, the block that fills it, and how many of its words."""
    slots, spare = needs(plan)
    total = int(slots.sum())
    shards = -(-total // shard_slots)
    each = -(-shards // max(1, min(1024, shards, (1 << 22) // max(1, len(slots)))))
    groups, left, begun, rng = [], slots.copy(), np.zeros(len(slots), np.int64), np.random.default_rng([plan.seed, 0])
    for first in range(0, shards, max(1, each)):
        n = min(each * shard_slots, total - first * shard_slots)
        drawn = _draw(rng, n, left)
        groups.append((first, n, drawn, begun.copy()))
        left, begun = left - drawn, begun + drawn
    parts = max(1, min(len(groups), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, len(groups), 1, parts).mapInArrow(_dealt(plan, slots, spare, shard_slots, groups), _SLOTS)


def measured(df: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, source, size in words, a hash of the text for ties and, if asked for, the whole row as a struct."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie"), *([F.struct(*(F.col(c) for c in df.columns)).alias("row")] if whole else []))


def planned(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 64, seed: int = 17) -> tuple[Plan, int]:
    """(Plan, documents) of a measured table. Only one row for each source comes to the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).take(MOST_SOURCES + 1)
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in rows]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], share, most)
    return Plan([r.source for r in rows], np.array(sizes, np.int64), np.array(goal, np.float64), block, seed), sum(r.docs for r in rows)


def placed(sized: DataFrame, plan: Plan, docs: int) -> DataFrame:
    """Measured documents with source_no, bucket and rank (which name a row), source_size, target, and the word of their source's stream at which they start."""
    spark = sized.sparkSession
    names = spark.createDataFrame([(s, k, int(plan.sizes[k]), float(plan.targets[k])) for k, s in enumerate(plan.sources)], "name string, source_no int, source_size long, target double")
    names = F.broadcast(names) if len(plan.sources) <= 100_000 else names
    buckets = max(64, -(-docs // 4096))
    rows = sized.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("source_no", "bucket", (F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("n")).alias("base"))
    order = Window.partitionBy("source_no", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "tie")
    rows = rows.withColumns({"rank": F.row_number().over(order), "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("base", "upto")


def mixed(rows: DataFrame, plan: Plan, shard_slots: int = 1024, how: str = "inner") -> DataFrame:
    """Rows of the mix: for each slot and each document of its block the words taken, word_start counted in the document. how="left" keeps documents that give none."""
    b = plan.block
    parts = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))))
    # The slots grow with the words, whatever the planner makes of the few rows that they come from: never broadcast.
    got = parts.join(slots_of(rows.sparkSession, plan, shard_slots).hint("merge"), ["source_no", "block"], how)
    low, high = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("take"))
    got = got.withColumn("words", F.when(F.col("shard").isNull(), 0).otherwise(F.greatest(F.lit(0), high - low)).cast("long")).withColumn("word_start", low - F.col("start"))
    return got if how == "left" else got.filter("words > 0")


def mix(df: DataFrame, **options) -> DataFrame:
    """The mix of df (doc_id, text, source) as rows: shard, slot, source, pass, block, doc_id, word_start, words."""
    sized = written(measured(df))
    plan, docs = planned(sized, **options)
    return mixed(placed(sized, plan, docs), plan).select("shard", "slot", "source", "pass", "block", "doc_id", "word_start", "words")


def taken(df: DataFrame, **options) -> DataFrame:
    """One row for each row of df: doc_id, size, source_size, target of its source, and the words that the mix takes of it."""
    sized = written(measured(df))
    plan, docs = planned(sized, **options)
    got = mixed(placed(sized, plan, docs), plan, how="left")
    out = got.groupBy("source_no", "bucket", "rank").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source", "source_size", "target")), F.sum("words").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def _part(text: str, runs: list[tuple[int, int]]) -> str:
    words = _WORDS.findall(text)
    return " ".join(" ".join(words[s : s + n]) for s, n in runs)


@F.arrow_udf(StringType())
def _taken_words(text: pa.Array, runs: pa.Array, size: pa.Array) -> pa.Array:
    out = [t if len(r) == 1 and r[0]["n"] == n else _part(t, [(x["s"], x["n"]) for x in r]) for t, r, n in zip(map(pa.StringScalar.as_py, text), map(pa.ListScalar.as_py, runs), size.to_pylist(), strict=True)]
    done = pa.array(out, pa.string())
    del out
    tidy()
    return done


def documents(df: DataFrame, **options) -> DataFrame:
    """df as its mix: one row for each document and pass that takes any of its words, with the taken words as text (the text as it is when all are taken). Documents that are not taken do not appear."""
    plan, docs = planned(measured(df), **options)
    rows = written(placed(measured(df, whole=True), plan, docs))
    found = mixed(rows.drop("row"), plan).groupBy("source_no", "bucket", "rank", "pass").agg(F.array_sort(F.collect_list(F.struct(F.col("word_start").alias("s"), F.col("words").alias("n")))).alias("runs"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["s"] + F.element_at(acc, -1)["n"] == x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), (F.element_at(acc, -1)["n"] + x["n"]).alias("n"))))).otherwise(F.concat(acc, F.array(x)))
    found = found.withColumn("runs", F.aggregate("runs", F.slice("runs", 1, 0), step))
    got = rows.join(found, ["source_no", "bucket", "rank"])
    got = got.select("row", "runs", "size").withColumn("taken", _taken_words(F.col("row.text").cast("string"), "runs", "size"))
    return got.select(*(F.col("taken").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in df.columns))
