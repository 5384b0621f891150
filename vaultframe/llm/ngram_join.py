"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct k-word shingles. Documents of equal sets are one node; nodes link when
den * |x and y| >= num * |x or y|.

Tokens are classed by how many documents hold them: frequent ones (up to MOST_FREQUENT of the corpus, those above the
least bound that leaves so few) and rare ones; rare come first in the order, then by hash. With at most e of its n tokens
missing in a partner, a node with more than e rare tokens is indexed by the first e + 1 of them, singly. One with fewer
is indexed by all its rare tokens, and its prefix extends over all of its frequent ones: they are dealt by hash to more
buckets than a linked pair can have differing tokens, and each bucket's combination of tokens is a key. As linked
nodes differ in fewer tokens than there are buckets, they agree in one; so no link is lost:
if neither x nor y has enough rare tokens they share a rare token or a bucket, otherwise the one whose prefix ends first
keeps one of its e + 1 tokens in the other's prefix. Empty buckets are no keys: a node with more filled buckets than
tokens that can differ agrees with its partner in a filled one. A node with fewer is dealt anew by another hash, SEEDS
times at most, and only then are its empty buckets keys, too.

Keys that few nodes share give their pairs. Of keys of many nodes (groups of near copies, which share hundreds) those with
mostly the same nodes become one, whose nodes are compared in blocks: first each block with itself and the next, then
all blocks of the keys whose nodes are still of different components. A lower bound of the difference, from counts of
tokens by hash cell, drops pairs that cannot link; all others are verified with their whole sets. For keys of many nodes
both happen where a block is: it first names the nodes that have a possible partner, then, given their sets, only
links that join what is still apart. So what they write grows with their nodes, not with their pairs.

Texts that are null or have no words have no shingles and link with nothing, not even each other. Rows of equal doc_id
are documents of their own, those of null doc_id too; a component's id is null only if all of its doc_ids are. An empty table gives no rows. Other columns are ignored. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from vaultframe.llm import words
from vaultframe.llm.common import attached, parts, pieces, tidy, written
from vaultframe.llm.components import components

#: Bound of the table of frequent tokens that every task holds.
MOST_FREQUENT = 1 << 20
#: Documents that a rare token is in at most, while the table of frequent ones has room.
RARE = 8
#: Nodes of a key that give all pairs; nodes of a block, and about how many tokens its sets have.
FEW, BLOCK, TOKENS = 32, 2048, 1 << 19
#: Times that keys with mostly the same nodes are sought.
BUNDLES = 3
#: Ids that may be broadcast; more are joined by shuffles.
MOST_BROADCAST = 1 << 20
CELLS = 128
_REST = 24  # bits of a token's hash below its slice
#: Times that a node's frequent tokens are dealt to buckets.
SEEDS = 8
_COUNTED = np.dtype([("rest", "<u4"), ("n", "<u4")])


def sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): sorted distinct shingle hashes of each text, of k words, or of all words where there are fewer."""
    h, offsets, _, _ = words.hashed(text, lower=True)
    n = np.diff(offsets)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate(([0], np.cumsum(size)))
    whole = words.runs(h, k)
    source = np.arange(to[-1]) + np.repeat(offsets[:-1] - to[:-1], size)
    flat = whole[np.minimum(source, len(whole) - 1)] if len(whole) else np.zeros(len(source), np.uint64)
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        flat[to[i]] = words.runs(h[offsets[i] : offsets[i + 1]], int(n[i]))[0] + np.uint64(n[i])
    for s, e in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        flat[s:e].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[to[:-1][size > 0]] = True
    return flat[fresh], np.concatenate(([0], np.cumsum(fresh)))[to]


def names(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each set's node: a hash of all its tokens, as a signed number."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(flat))))
    return words.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def missing(n, num: int, den: int):
    """Tokens of a set of n that may be missing in a linked one."""
    return n - -(-num * n // den)


class Levels:
    """Size classes, each a quarter as wide again as the one before, and the buckets for each. Linked sets meet in the class of the larger one, so a set is in its own class and in that of its largest partner."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1]

    def _at(self, n: int) -> int:
        while self.bounds[-1] <= n:
            last = self.bounds[-1]
            self.bounds.append(max(last * 5 // 4, last * self.den // self.num) + 1)
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def of(self, n: int) -> list[int]:
        return sorted({self._at(n), self._at(n * self.den // self.num)})

    def enough(self, level: int) -> int:
        """One more than the tokens by which linked sets of sizes within the class can differ."""
        return (self.den - self.num) * 2 * (self.bounds[level + 1] - 1) // (self.den + self.num) + 1


def combinations(often: np.ndarray, level: int, enough: int) -> list[np.ndarray]:
    """Keys of a node's frequent tokens in a size class: the combinations of its buckets."""
    out, weight = [], words.mix(often)
    buckets = enough + enough // 4 + 2
    for seed in range(SEEDS):
        at = (words.mix(often ^ np.uint64(0xA5A5A5A5A5A5A5A5 + seed)) % np.uint64(buckets)).astype(np.int64)
        total, filled = np.zeros(buckets, np.uint64), np.zeros(buckets, bool)
        np.add.at(total, at, weight)
        filled[at] = True
        keys = words.mix(total + words.mix(np.arange(buckets, dtype=np.uint64) + np.uint64(level << 40 | seed << 56 | 1 << 62)))
        done = int(filled.sum()) >= enough
        out.append(keys if seed + 1 == SEEDS and not done else keys[filled])
        if done:
            break
    return out


def keys(s: np.ndarray, frequent: np.ndarray, num: int, den: int, levels: Levels) -> np.ndarray:
    """A node's index keys, given which of its tokens are frequent."""
    e = missing(len(s), num, den)
    rare = s[~frequent]
    if len(rare) > e:
        return rare[: e + 1]
    return np.concatenate([rare, *(c for at in levels.of(len(s)) for c in combinations(s[frequent], at, levels.enough(at)))])


def cells(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Counts of each set's tokens by hash cell, a byte each."""
    n = len(offsets) - 1
    counts = np.bincount(words.segments(offsets) * CELLS + (flat >> np.uint64(64 - 7)).astype(np.int64), minlength=n * CELLS)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(CELLS)), pa.py_buffer(np.minimum(counts, 255).astype(np.uint8))])


def _each(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice of a batch, tokens, offsets and nodes of its sets)."""
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            flat, offsets = sets(part.column("text"), k)
            yield part, flat, offsets, names(flat, offsets)
    tidy()


def _fresh(nodes: np.ndarray, offsets: np.ndarray, seen: set[int]) -> np.ndarray:
    """Numbers of the sets that have tokens and were not seen before, which are seen from now on."""
    out = []
    for i in np.flatnonzero(np.diff(offsets)).tolist():
        if (own := int(nodes[i])) not in seen:
            seen.add(own)
            out.append(i)
    return np.array(out, np.int64)


def _taken(flat: np.ndarray, offsets: np.ndarray, sets_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of some of the sets."""
    size = np.diff(offsets)
    if len(sets_of) == len(size):
        return flat, offsets
    keep = np.zeros(len(size), bool)
    keep[sets_of] = True
    return flat[np.repeat(keep, size)], np.concatenate(([0], np.cumsum(size[sets_of])))


def _nodes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, offsets, nodes in _each(batches, k):
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, mask=n == 0), cells(flat, offsets)], ["doc_id", "n", "node", "cells"])

    return run


def _slices(k: int, bits: int, most: int = 1_000_000):
    """Every token as its slice and the _REST bits that follow, packed by slice: `rest` has those that about `most` tokens of a task hold once, in three bytes each, `many` the others with their counts; so a token of very many documents adds little to its slice. A task's copies of a set count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            top = np.concatenate(held) >> np.uint64(64 - bits - _REST)
            top.sort()
            at = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
            top, count = top[at], np.diff(np.append(at, len(top)))
            part, once = (top >> np.uint64(_REST)).astype(np.int32), count == 1
            rows = np.empty(len(top), _COUNTED)
            rows["rest"], rows["n"] = top & np.uint64((1 << _REST) - 1), count
            low, rows = rows["rest"][once].view(np.uint8).reshape(-1, 4)[:, :3], rows[~once]
            slices = np.arange((1 << bits) + 1)
            a, b = np.searchsorted(part[once], slices), np.searchsorted(part[~once], slices)
            used = np.flatnonzero(np.diff(a) + np.diff(b))
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([x[w[i] : w[i + 1]].tobytes() for i in used.tolist()], pa.binary()) for x, w in ((low, a), (rows, b)))], ["slice", "rest", "many"])

        for _, flat, offsets, nodes in _each(batches, k):
            tokens = _taken(flat, offsets, _fresh(nodes, offsets, seen))[0]
            held.append(tokens)
            size += len(tokens)
            if size > most:
                yield packed()
                held.clear()
                size = 0
        if size:
            yield packed()

    return run


def _often(more_than: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = np.frombuffer(b"".join(rows.column("rest").to_pylist()), np.uint8).reshape(-1, 3)
        once = b[:, 0].astype(np.int64) | b[:, 1].astype(np.int64) << 8 | b[:, 2].astype(np.int64) << 16
        many = np.frombuffer(b"".join(rows.column("many").to_pylist()), _COUNTED)
        token, back = np.unique(np.concatenate((once, many["rest"].astype(np.int64))), return_inverse=True)
        n = np.bincount(back, np.concatenate((np.ones(len(once)), many["n"])), len(token)).astype(np.int64)
        kept = n > more_than
        return pa.table([pa.array((key[0].as_py() << _REST) + token[kept], pa.int64()), pa.array(n[kept], pa.int64())], ["token", "n"])

    return run


def frequent_tokens(docs: DataFrame, tokens: int, k: int) -> tuple[np.ndarray, int]:
    """(heads of the hashes of frequent tokens, sorted; bits of a head). Counts are of all documents."""
    bits = max(8, (max(1, tokens) >> 21).bit_length())
    counts = written(docs.mapInArrow(_slices(k, bits), "slice int, rest binary, many binary").groupBy("slice").applyInArrow(_often(RARE), "token long, n long"))
    bound, n = RARE, counts.count()
    while n > MOST_FREQUENT:
        bound *= 2
        n = counts.filter(F.col("n") > bound).count()
    rows = counts.filter(F.col("n") > bound).select("token").toPandas()["token"].to_numpy(np.int64)  # at most MOST_FREQUENT
    return np.sort(rows), bits + _REST


class Frequent:
    """Which tokens are frequent, by the heads of their hashes; a table of flags by the first bits sorts most others out."""

    def __init__(self, heads: np.ndarray, bits: int, first: int = 22):
        self.heads, self.shift, self.first = heads, np.uint64(64 - bits), np.uint64(64 - first)
        self.flags = np.zeros(1 << first, bool)
        self.flags[heads >> (bits - first)] = True

    def of(self, flat: np.ndarray) -> np.ndarray:
        out = self.flags[flat >> self.first]
        some = np.flatnonzero(out)
        if len(some):
            head = (flat[some] >> self.shift).astype(np.int64)
            out[some] = self.heads[np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)] == head
        return out


def _postings(k: int, num: int, den: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, levels, seen = Frequent(*table.value), Levels(num, den), set()
        for _, flat, offsets, nodes in _each(batches, k):
            kept = _fresh(nodes, offsets, seen)
            if not len(kept):
                continue
            flat, offsets = _taken(flat, offsets, kept)
            n, of, often = np.diff(offsets), words.segments(offsets), frequent.of(flat)
            before = np.concatenate(([0], np.cumsum(~often)))
            rare, e = before[offsets[1:]] - before[offsets[:-1]], missing(n, num, den)
            enough = rare > e
            first = ~often & enough[of] & (before[:-1] - before[offsets[:-1]][of] <= e[of])
            out, at = [flat[first]], [of[first]]
            for i in np.flatnonzero(~enough).tolist():
                s = slice(offsets[i], offsets[i + 1])
                out.append(keys(flat[s], often[s], num, den, levels))
                at.append(np.full(len(out[-1]), i))
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(nodes[kept][at]), pa.array(n[at], pa.int32())], ["key", "node", "n"])

    return run


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, offsets, nodes in _each(batches, k):
            some = np.diff(offsets) > 0
            at = np.append(offsets[:-1][some], len(flat))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))], ["node", "tokens"])

    return run


def _near(num: int, den: int):
    @F.arrow_udf(BooleanType())
    def near(a: pa.Array, b: pa.Array, m: pa.Array, n: pa.Array) -> pa.Array:
        """Whether the counts by cell allow a link of sets of m and n tokens."""
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in (a, b))
        both = m.to_numpy() + n.to_numpy()
        return pa.array(np.abs(x - y).sum(1) <= (den - num) * both // (den + num))

    return near


def _candidates(n: np.ndarray, comp: np.ndarray, part: np.ndarray | None, h: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), sorted, of different components (and parts, if given) that may link by their sizes and counts by cell, some rows at a time. Sets are sorted by size; comp may change between."""
    c, until = len(n), den * n // num
    small, h = h.reshape(-1, 16, CELLS // 16).sum(2, dtype=np.int16), h.astype(np.int16)
    start, step = 0, 2
    while start < c:
        step = max(1, min(step, (1 << 17) // c))  # differences of some MB at a time
        i = np.arange(start, min(start + step, c))
        ok = (np.arange(start, c) > i[:, None]) & (n[start:] <= until[i][:, None]) & (comp[start:] != comp[i][:, None])
        if part is not None:
            ok &= part[start:] != part[i][:, None]
        a, b = np.nonzero(ok)
        a, b = a + start, b + start
        for sketch in (small, h):
            kept = [np.abs(sketch[a[k : k + 65536]] - sketch[b[k : k + 65536]]).sum(1, dtype=np.int32) <= (den - num) * (n[a[k : k + 65536]] + n[b[k : k + 65536]]) // (den + num) for k in range(0, len(a), 65536)]
            kept = np.concatenate(kept) if kept else np.zeros(0, bool)
            a, b = a[kept], b[kept]
        yield a, b
        start, step = start + step, 2 * step


def _ordered(key: tuple[pa.Scalar, ...], rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray | None]:
    """(rows by size, sizes, components as numbers from 0, parts if the group is of two blocks)."""
    rows = rows.take(pa.array(np.lexsort((rows.column("node").to_numpy(), rows.column("n").to_numpy()))))
    _, comp = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    apart = key[1].as_py() != key[2].as_py()
    return rows, rows.column("n").to_numpy().astype(np.int64), comp, rows.column("part").to_numpy() if apart else None


def _screened(num: int, den: int):
    """Rows of a block, or of two blocks, that may link with one of another component."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows, n, comp, part = _ordered(key, rows)
        some, h = np.zeros(len(n), bool), np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        for a, b in _candidates(n, comp, part, h, num, den):
            some[a] = some[b] = True
        return rows.drop_columns("cells").filter(pa.array(some))

    return run


def _linked(num: int, den: int):
    """Links of a block, or of two blocks, that join what is still apart: fewer than nodes, and enough to join all that link."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows, n, comp, part = _ordered(key, rows)
        node, to = rows.column("node").to_numpy(), np.concatenate(([0], np.cumsum(n)))
        flat = np.concatenate([chunk.flatten().to_numpy() for chunk in rows.column("tokens").chunks])
        h = np.frombuffer(cells(flat.view(np.uint64), to).buffers()[2], np.uint8).reshape(-1, CELLS)
        token, flat = np.unique(flat, return_inverse=True)
        held, found, apart = np.zeros(len(token), bool), [], int(comp.max(initial=-1)) + 1
        for a, b in _candidates(n, comp, part, h, num, den):
            rows_of, first = np.unique(a, return_index=True)
            for x, ys in zip(rows_of.tolist(), np.split(b, first[1:]), strict=False):
                ys = ys[comp[ys] != comp[x]]
                if not len(ys):
                    continue
                own = flat[to[x] : to[x + 1]]
                held[own] = True
                at = np.cumsum(n[ys]) - n[ys]
                shared = np.add.reduceat(held[flat[np.arange(n[ys].sum()) + np.repeat(to[ys] - at, n[ys])]], at, dtype=np.int64)
                held[own] = False
                ys = ys[den * shared >= num * (n[x] + n[ys] - shared)]
                joins, one = np.unique(comp[ys], return_index=True)
                comp[np.isin(comp, joins)] = comp[x]
                found += [(int(node[x]), int(node[y])) for y in ys[one].tolist()]
                apart -= len(joins)
            if apart == 1:
                break
        tidy()
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    return run


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


class Join:
    """The join of one table of documents (doc_id, text)."""

    def __init__(self, df: DataFrame, k: int = 3, num: int = 90, den: int = 100):
        self.k, self.num, self.den = k, num, den
        self.docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        #: One row for each document: doc_id, n, node (null without shingles), cells.
        self.nodes = written(self.docs.mapInArrow(_nodes(k), "doc_id long, n long, node long, cells binary"))
        #: (node, component) of the nodes that link with another.
        self.components = self._components()

    def _size_fits(self, small: Column, large: Column) -> Column:
        return self.num * large <= self.den * small

    def _tokens(self, ids: DataFrame) -> DataFrame:
        """(node, tokens) of the nodes (doc_id, node), and maybe of others."""
        some = self.docs.join(_small(ids.select("doc_id").distinct(), ids.count()), "doc_id", "left_semi")
        tokens = some.mapInArrow(_whole(self.k), "node long, tokens array<long>")
        unnamed = ids.filter("doc_id is null").select("node")
        if not unnamed.isEmpty():  # texts that only rows without a doc_id hold
            tokens = tokens.union(self.docs.filter("doc_id is null").mapInArrow(_whole(self.k), "node long, tokens array<long>").join(unnamed, "node", "left_semi"))
        return written(tokens.dropDuplicates(["node"]))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that link."""
        near = _near(self.num, self.den)
        sketch = lambda end: self.first.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "cells", "doc_id")))
        near_pairs = written(pairs.distinct().join(sketch("a"), "a").join(sketch("b"), "b").filter(near("cells_a", "cells_b", "n_a", "n_b")).select("a", "b", "doc_id_a", "doc_id_b"))
        pairs = near_pairs.select("a", "b")
        ends = F.array(*(F.struct(F.col(f"doc_id_{end}").alias("doc_id"), F.col(end).alias("node")) for end in ("a", "b")))
        tokens = self._tokens(written(near_pairs.select(F.explode(ends).alias("e")).select("e.*").distinct()))
        both = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return written(both.filter(self.den * shared >= self.num * (F.size("x") + F.size("y") - shared)).select("a", "b"))

    def _components(self) -> DataFrame:
        known = self.nodes.filter("node is not null")
        #: One row for each node.
        self.first = written(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("cells").alias("cells")))
        tokens = self.nodes.agg(F.sum("n")).first()[0] or 0
        spark = self.docs.sparkSession
        table = spark.sparkContext.broadcast(frequent_tokens(self.docs, tokens, self.k))
        postings = written(self.docs.mapInArrow(_postings(self.k, self.num, self.den, table), "key long, node long, n int"))
        shared = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("c")).filter("low <> high").select("key", "c")
        postings = written(postings.join(shared, "key"))
        lists = postings.filter(F.col("c") <= FEW).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("n", "node"))).alias("l"))
        after = lambda x: F.transform(F.filter("l", lambda y: (y > x) & self._size_fits(x["n"], y["n"])), lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))
        pairs = lists.select(F.explode(F.flatten(F.transform("l", after))).alias("p")).select("p.*")
        many = postings.filter(F.col("c") > FEW).distinct()
        # Of keys that the same nodes share one is enough.
        same = many.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("low"), F.count("*").alias("held")).groupBy("x", "low", "held").agg(F.min("key").alias("key"))
        many = written(many.join(same.select("key"), "key", "left_semi"))
        crowded = not many.isEmpty()
        comps = written(components(self._verified(pairs)))
        if not crowded:
            return comps
        many = self._bundled(self._open(many, comps))
        for every in (False, True):
            links = self._crowds(many, every)
            if not links.isEmpty():
                # What is merged is as many links as it has nodes, however many were found.
                stars = comps.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                comps = written(components(stars.union(links)))
            # Of three blocks each has met itself and both others by now.
            many = many.filter("cuts > 3")
            if every or many.isEmpty():
                break
            many = self._open(many, comps)
        return comps

    def _bundled(self, many: DataFrame) -> DataFrame:
        """(key, node, n, component, cuts, part): keys with mostly the same nodes as one, with the nodes of all. Keys that have the same least node, by a hash, are such; they become one where its pairs are no more than theirs."""
        for seed in range(BUNDLES):
            least = written(many.groupBy("key").agg(F.min(F.xxhash64("node", F.lit(seed))).alias("least"), F.count("*").alias("held")))
            one = many.join(least, "key").groupBy("least").agg(F.countDistinct("node").alias("all"), F.sum("held").alias("pairs"), F.min("key").alias("one")).filter("all * all <= pairs")
            of = least.join(one, "least").select("key", "one")
            many = written(many.join(of, "key", "left").select(F.coalesce("one", "key").alias("key"), "node", "n", "component").distinct())
        cuts = many.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).cast("int").alias("cuts"))
        return written(many.join(cuts, "key").withColumn("part", F.pmod(F.xxhash64("node"), "cuts").cast("int")))

    def _open(self, many: DataFrame, comps: DataFrame) -> DataFrame:
        """Of (key, node, ...) the keys whose nodes are of different components, with these."""
        held = many.drop("component").join(comps.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node")).drop("of")
        held = written(held)
        open_keys = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        return written(held.join(open_keys, "key", "left_semi"))

    def _crowds(self, many: DataFrame, every: bool) -> DataFrame:
        """Links (a, b) of nodes of keys of many nodes, enough to join all that link. At first a block meets itself and the next, so that its cost is linear; groups of near copies close by that. With every, all blocks meet."""
        held = many.join(self.first.select("node", "cells"), "node")
        others = F.sequence(F.lit(0), F.col("cuts") - 1) if every else F.array_distinct(F.array("part", F.pmod(F.col("part") + 1, "cuts"), F.pmod(F.col("part") - 1, "cuts")))
        two = F.transform(others, lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
        held = held.select("key", "node", "n", "component", "part", "cells", F.explode(two).alias("b")).select("key", "b.i", "b.j", "node", "n", "component", "part", "cells")
        some = written(held.groupBy("key", "i", "j").applyInArrow(_screened(self.num, self.den), held.drop("cells").schema))
        tokens = self._tokens(written(self.first.join(some.select("node").distinct(), "node", "left_semi").select("doc_id", "node")))
        return written(some.join(tokens, "node").groupBy("key", "i", "j").applyInArrow(_linked(self.num, self.den), "a long, b long").distinct())

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        least = self.first.select("node", "doc_id").join(self.components, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of = self.components.join(least, "component").select("node", "component_id")
        info = self.first.select("node", "doc_id").join(of, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
        out = attached(self.nodes.select("doc_id", F.col("n").alias("n_shingles"), "node"), self.first.select("node", "c"), info, "node")
        return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(df: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    return Join(df, k, num, den).classes()


def _node(k: int):
    @F.arrow_udf(LongType())
    def node(text: pa.Array) -> pa.Array:
        out = [pa.array([], pa.int64())]
        for part in parts(text):
            flat, offsets = sets(part, k)
            out.append(pa.array(names(flat, offsets), mask=np.diff(offsets) == 0))
        tidy()
        return pa.concat_arrays(out)

    return node


def keep_one(df: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """df with one row of each group: that of the smallest doc_id (null is the last), one of equal rows. Rows without shingles all stay."""
    join = Join(df, k, num, den)
    group = join.first.join(join.components, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    kept = written(group.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x")).select(F.col("x.doc_id").alias("__doc"), F.col("x.node").alias("__kept")))
    text = F.col("text").cast("string")
    rows = df.withColumns({"text": text, "__node": _node(k)(text)})
    own = rows.join(_small(kept, kept.count()), (F.col("__node") == F.col("__kept")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left")
    repeated = join.nodes.filter("node is not null").groupBy("doc_id", "node").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("__d"), F.col("node").alias("__n"))
    stay = own.filter("__node is null or __kept is not null")
    if not repeated.isEmpty():  # rows that are there again: only these are shuffled
        again = stay.join(repeated, (F.col("__node") == F.col("__n")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left")
        stay = again.filter("__n is null").drop("__d", "__n").unionByName(again.filter("__n is not null").drop("__d", "__n").dropDuplicates(["__node", "__doc"]))
    return stay.select(*df.columns)
