"""Substring dedup by repeated-phrase automata.

A window is `window` consecutive words. Its anchor is the phrase of `phrase` words in it with the least hash, so equal
windows have equal anchors, and a sixth of all phrases are anchors. Anchors that two texts of a task hold, or one text
twice, are known to recur there; the others are counted in slices of the hash space, to which a task sends each anchor once, however many of its
texts hold it. Texts are dealt to shards; each
shard compiles an Aho-Corasick automaton of the recurring phrases of its texts (words as pairs of symbols) and streams
its texts through it to locate every occurrence. Windows whose anchor is located are candidates: their hashes get the
earliest (doc_id, start) of all that are equal, and a window that is not its earliest covers words to remove.

Texts of the same words are dealt with once: all but the first lose every word if they have a window at all. Null and
empty texts have no words; texts shorter than a window keep all. Rows of equal doc_id: their copies of one text remove
nothing of each other, and other texts of the same doc_id are ordered by a hash of their words; null doc_ids come last.
An empty table gives no rows. Other columns are ignored. Hashes of windows and of texts have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import words
from vaultframe.llm.common import attached, partitions_for, pieces, tidy, written

_EMPTY = hashlib.sha256(b"").hexdigest()
_LAST = (1 << 63) - 1
_REST = 32  # bits of an anchor's hash below its slice
_ANCHOR = np.dtype([("head", "<u4"), ("sequence", "<u8"), ("twice", "?")])


def _sequences(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each text's whole sequence of words."""
    n = np.diff(offsets)
    place = np.arange(len(h)) - np.repeat(offsets[:-1], n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))))
    return words.mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least(v: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours, by doubling."""
    span, out = 1, v
    while span * 2 <= k:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(v) - k + 1], out[k - span :]) if span < k else out


def anchors(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each phrase, hash of each window's anchor) of one text's words."""
    grams = words.runs(h, phrase)
    return grams, least(grams, window - phrase + 1)


def _measured(window: int):
    """Each row's number of words, sequence hash (null where there is no window) and digest of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                h, offsets, starts, ends = words.hashed(part.column("text"))
                flat, to = words.joined(words.raw(part.column("text"))[0], offsets, starts, ends)
                digests = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(_sequences(h, offsets).view(np.int64), mask=n < window), pa.array(digests)], ["doc_id", "n", "sequence", "digest"])
        tidy()

    return run


def _packed(key: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """rows by key, those of a key as one cell."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    to = np.append(at, len(key))[1:]
    return pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(at.tolist(), to.tolist(), strict=True)], pa.binary())], ["key", "heads"])


def used_anchors(h: np.ndarray, offsets: np.ndarray, texts: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, whether the text holds that phrase again) of the anchors of some texts; an anchor can come more than once."""
    grams = words.runs(h, phrase)
    m = least(grams, window - phrase + 1)
    of = words.segments(offsets)
    chosen = np.zeros(len(offsets) - 1, bool)
    chosen[texts] = True
    whole = chosen[of[: len(m)]] & (np.arange(len(m)) + window <= offsets[of[: len(m)] + 1])
    fresh = whole.copy()
    fresh[1:] &= (m[1:] != m[:-1]) | ~whole[:-1] | (of[1 : len(m)] != of[: len(m) - 1])
    at = np.flatnonzero(fresh)
    # A phrase that stands in the text again recurs, whichever of its places are anchors.
    again = []
    for k in texts.tolist():
        g = np.sort(grams[offsets[k] : offsets[k + 1] - phrase + 1])
        double = g[1:][g[1:] == g[:-1]]
        if len(double):
            again.append(words.mix(double + np.uint64(k)))
    name = words.mix(m[at] + of[at].astype(np.uint64)) if again else m[at]
    return of[at], m[at], np.isin(name, np.concatenate(again)) if again else np.zeros(len(at), bool)


def _sliced(window: int, phrase: int, bits: int, shards: int, most: int = 1_000_000):
    """Anchors by key, packed: below 2**bits the key is a slice of hashes, and the cell holds heads with the sequence hash of a text and whether they are known to recur; from there on it is a shard, and the cell holds heads that recur in its texts. Of about `most` anchors of a task each head goes to its slice once."""
    head = np.uint64(64 - bits - _REST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            heads, own, twice = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(heads, kind="stable")
            heads, own, twice = heads[order], own[order], twice[order]
            at = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
            known = (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)) | np.logical_or.reduceat(twice, at)
            rows = np.empty(len(at), _ANCHOR)
            rows["head"], rows["sequence"], rows["twice"] = heads[at] & np.uint64((1 << _REST) - 1), own[at], known
            yield _packed((heads[at] >> np.uint64(_REST)).astype(np.int64), rows)
            some = np.repeat(known, np.diff(np.append(at, len(heads))))
            yield _packed((own[some] % np.uint64(shards)).astype(np.int64) + (1 << bits), heads[some])

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                h, offsets, _, _ = words.hashed(part.column("text"))
                names, texts = _sequences(h, offsets), []
                for k in np.flatnonzero(np.diff(offsets) >= window).tolist():
                    if (own := int(names[k])) not in seen:
                        seen.add(own)
                        texts.append(k)
                if not texts:
                    continue
                of, anchor, twice = used_anchors(h, offsets, np.array(texts), window, phrase)
                held.append((anchor >> head, names[of], twice))
                size += len(of)
                if size > most:
                    yield from packed()
                    held.clear()
                    size = 0
        if size:
            yield from packed()
        tidy()

    return run


def _recurring(shards: int, bits: int):
    """For each shard, the heads of its anchors that recur anywhere: two texts hold them, told apart by all 64 bits of their sequence hashes, or one repeats them."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        here, cells = key[0].as_py(), b"".join(rows.column("heads").to_pylist())
        if here >= 1 << bits:
            heads = np.unique(np.frombuffer(cells, np.uint64))
            return pa.table([pa.array([here - (1 << bits)], pa.int32()), pa.array([heads.tobytes()], pa.binary())], ["shard", "heads"])
        found = np.frombuffer(cells, _ANCHOR)
        found = found[np.argsort(found["head"], kind="stable")]
        first = np.flatnonzero(np.concatenate(([True], found["head"][1:] != found["head"][:-1])))
        names = np.ascontiguousarray(found["sequence"])
        recurs = (np.minimum.reduceat(names, first) != np.maximum.reduceat(names, first)) | np.logical_or.reduceat(found["twice"], first)
        held = found[np.repeat(recurs, np.diff(np.append(first, len(found))))]
        out = _packed((held["sequence"] % np.uint64(shards)).astype(np.int64), held["head"].astype(np.uint64) | np.uint64(here) << np.uint64(_REST))
        return pa.table([out.column("key").cast(pa.int32()), out.column("heads")], ["shard", "heads"])

    return run


def _texts(window: int, shards: int):
    """Texts with a window, by shard; of a task's copies those that begin earlier than all before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                h, offsets, _, _ = words.hashed(part.column("text"))
                names, keep = _sequences(h, offsets), []
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own, doc = int(names[k]), _LAST if doc is None else doc
                    if offsets[k + 1] - offsets[k] >= window and seen.get(own, _LAST + 1) > doc:
                        seen[own] = doc
                        keep.append(k)
                rows = part.take(pa.array(keep, pa.int64()))
                own = names[keep]
                yield pa.RecordBatch.from_arrays([pa.array((own % np.uint64(shards)).astype(np.int32)), pa.array(own.view(np.int64)), rows.column("doc_id").fill_null(_LAST), rows.column("text")], ["shard", "sequence", "doc_id", "text"])

    return run


def _symbols(h: np.ndarray) -> str:
    """Two characters for each word, of different ranges, so that phrases match only at words."""
    out = np.empty(2 * len(h), "<u4")
    out[0::2], out[1::2] = 0x30 + (h & np.uint64(63)), 0x100 + (h >> np.uint64(6) & np.uint64(63))
    return out.tobytes().decode("utf-32-le")


def _located(window: int, phrase: int, bits: int):
    """Candidate windows (starts, hashes) of a shard's texts, located by its automaton."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, found: pa.Table) -> pa.Table:
        import ahocorasick

        heads = np.unique(np.frombuffer(b"".join(found.column("heads").to_pylist()), np.uint64))
        first: dict[int, int] = {}
        docs, names = texts.column("doc_id").to_pylist(), texts.column("sequence").to_pylist()
        for k, own in enumerate(names):
            if own not in first or docs[k] < docs[first[own]]:
                first[own] = k
        kept = texts.take(pa.array(sorted(first.values()), pa.int64())).combine_chunks()
        out: list[list] = [[], [], [], [], []]
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        known: set[int] = set()
        text = [(x, *words.hashed(x.column("text"))) for b in kept.to_batches() for x in pieces(b, "text", 1 << 20)] if len(heads) else []
        for _, h, _, _, _ in text:
            grams = words.runs(h, phrase)
            head = grams >> np.uint64(64 - bits - _REST)
            again = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, head), len(heads) - 1)] == head)
            _, once = np.unique(grams[again], return_index=True)
            symbols = _symbols(h)
            for j, g in zip(again[once].tolist(), grams[again[once]].tolist(), strict=True):
                if g not in known:
                    known.add(g)
                    machine.add_word(symbols[2 * j : 2 * (j + phrase)])
        if known:
            machine.make_automaton()
        for part, h, offsets, begin, end in text if known else []:
            symbols, data = _symbols(h), words.raw(part.column("text"))[0]
            grams, m = anchors(h, window, phrase)
            here = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                places = np.fromiter((x for x, _ in machine.iter(symbols[2 * s : 2 * e])), np.int64)
                places = s + (places + 1) // 2 - phrase
                here[places] = grams[places]
            of = words.segments(offsets)[: len(m)]
            at = np.flatnonzero((least(here, window - phrase + 1) == m) & (np.arange(len(m)) + window <= offsets[of + 1]))
            hashes = words.runs(h, window)
            cuts = np.searchsorted(at, offsets)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                s, e, starts = offsets[k], offsets[k + 1], at[cuts[k] : cuts[k + 1]]
                whole = words.joined(data, np.array([0, e - s]), begin[s:e], end[s:e])[0]
                for column, value in zip(out, (part.column("sequence")[k].as_py(), part.column("doc_id")[k].as_py(), whole.tobytes(), (starts - s).astype("<i4").tobytes(), hashes[starts].tobytes()), strict=True):
                    column.append(value)
        done = pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["sequence", "doc_id", "words", "starts", "hashes"])
        del out, text, known, machine
        tidy()
        return done.set_column(2, "words", done.column("words").cast(pa.string()))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 64):
            part = batch.slice(k, 64)
            starts = [np.frombuffer(b, "<i4") for b in part.column("starts").to_pylist()]
            n = [len(s) for s in starts]
            hashes = np.frombuffer(b"".join(part.column("hashes").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.repeat(part.column("doc_id").to_numpy(), n)), pa.array(np.concatenate(starts)), pa.array(np.repeat(part.column("sequence").to_numpy(), n))], ["hash", "doc_id", "start", "sequence"])


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps[:n]) > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                later = np.setdiff1d(np.frombuffer(row["starts"], "<i4"), np.array(row["earliest"] or [], np.int32), assume_unique=True)
                if not len(later):
                    continue
                all_words = row["words"].split(" ")
                gone = covered(len(all_words), later, window)
                for column, value in zip(out, (row["sequence"], int(gone.sum()), " ".join([w for w, g in zip(all_words, gone.tolist(), strict=True) if not g])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["sequence", "n_removed", "kept"])

    return run


def cleaned(df: DataFrame, window: int = 20, phrase: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, counts, texts): rows have doc_id, n, sequence (null where there is no window), digest of all words and is_copy; counts (sequence, c) how many rows hold a text; texts have sequence, n_removed and the kept words of those distinct texts that lose some."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta = written(docs.mapInArrow(_measured(window), "doc_id long, n long, sequence long, digest string"))
    place = F.coalesce("doc_id", F.lit(_LAST))
    first = written(meta.filter("sequence is not null").groupBy("sequence").agg(F.min(place).alias("first_id"), F.count("*").alias("c")))
    rows = attached(meta, first, first.drop("c"), "sequence").withColumn("is_copy", F.coalesce(place > F.col("first_id"), F.lit(False))).drop("first_id")
    total = meta.agg(F.sum("n")).first()[0] or 0
    shards = max(partitions_for(df), total // 1_000_000, 1)
    bits = max(8, (total >> 22).bit_length())
    slices = docs.mapInArrow(_sliced(window, phrase, bits, shards), "key long, heads binary").groupBy("key").applyInArrow(_recurring(shards, bits), "shard int, heads binary")
    texts = docs.mapInArrow(_texts(window, shards), "shard int, sequence long, doc_id long, text string")
    found = texts.groupBy("shard").cogroup(slices.groupBy("shard")).applyInArrow(_located(window, phrase, bits), "sequence long, doc_id long, words string, starts binary, hashes binary")
    found = written(found)
    windows = found.select("sequence", "doc_id", "starts", "hashes").mapInArrow(_rows, "hash long, doc_id long, start int, sequence long")
    earliest = windows.groupBy("hash").agg(F.min(F.struct("doc_id", "sequence", "start")).alias("e")).select("e.sequence", "e.start").groupBy("sequence").agg(F.collect_list("start").alias("earliest"))
    texts = found.select("sequence", "words", "starts").join(earliest, "sequence", "left").mapInArrow(_cut(window), "sequence long, n_removed long, kept string")
    return rows, first.select("sequence", "c"), texts


def digest(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, counts, texts = cleaned(df, **options)
    own = written(texts.select("sequence", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
    out = attached(rows, counts, own, "sequence")
    copy = F.col("is_copy")
    return out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
