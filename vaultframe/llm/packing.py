"""Cost-balanced packing of tokenised documents into sequences.

Each task tokenises its own documents and packs them window by window (about `window` tokens each), so nothing is
shuffled and a lost task is simply run again. In a window of T tokens there are T // max_len full sequences, and one
for each power of two in the binary form of the rest: no sequence needs padding. A document is cut into full pieces
while it is longer than a sequence; the rests, longest first, go to the sequence of lowest cost (linear plus
quadratic attention cost of its pieces) that still has room, and are cut only where none has.

Null and empty texts are a document with the end token alone; equal texts and repeated rows are packed each on its
own; an empty table gives no rows; other columns are ignored. A window ends with the document that fills it, so a very long one
makes its window larger, by itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vaultframe.llm import words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

_known: dict[str, "Tokens"] = {}  # by path: workers are reused between tasks


#: Kinds of bytes between which pre-tokenisation always splits; apostrophes and bytes of other characters have none.
_KINDS = np.zeros(256, np.int8)
for _b in range(33, 127):
    _KINDS[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 0 if chr(_b) == "'" else 3


class Tokens:
    """Token ids of whole batches of texts, for a tokenizer whose pre-tokenisation drops white space, ignores case, and splits letters, digits and other ASCII characters from each other.

    Each distinct unit between such splits is encoded once and then looked up by its hash in a table of direct slots (a
    unit whose slot is taken is found in a dict). At most `most` units are remembered. Texts that hold the beginning of
    a special token are encoded by the tokenizer as they are.
    """

    def __init__(self, path: str, most: int = 1_000_000, slot_bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.shift = Tokenizer.from_file(path), most, np.uint64(64 - slot_bits)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.closes[k] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        slots = 1 << (64 - int(self.shift))
        self.place: dict[int, int] = {}
        self.tags, self.slots = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.ids, self.filled = np.zeros(1 << 20, np.uint16 if len(self.closes) < 1 << 16 else np.uint32), 0
        self.first, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n, m, k = len(self.place), len(counts), len(ids)
        while n + m > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.filled + k > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.filled : self.filled + k] = ids
        self.first[n : n + m], self.count[n : n + m] = self.filled + np.cumsum(counts) - counts, counts
        self.filled += k
        self.place.update(zip(hashes.tolist(), range(n, n + m), strict=True))
        at = (hashes >> self.shift).astype(np.int64)
        free = self.tags[at] == 0
        self.tags[at[free]], self.slots[at[free]] = hashes[free], np.arange(n, n + m)[free]
        wrong = free & (self.tags[at] == hashes) & (self.slots[at] != np.arange(n, n + m))
        self.slots[at[wrong]] = np.arange(n, n + m)[wrong]

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Units of ASCII letters are one pre-token each: many are encoded as one text, and the ends of words part them again."""
        plain = np.array([u.isalpha() for u in units], bool)  # of bytes: ASCII letters only
        rest = np.flatnonzero(~plain)
        for k in range(0, len(easy := np.flatnonzero(plain)), 2048):
            at = easy[k : k + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join([units[i] for i in at]).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(at) and ends[-1] == len(ids):
                self._keep(hashes[at], ids, np.diff(ends, prepend=0))
            else:
                rest = np.concatenate((rest, at))
        for k in range(0, len(rest), 2048):
            at = rest[k : k + 2048]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([units[i].decode("utf-8", "replace") for i in at], add_special_tokens=False)]
            self._keep(hashes[at], np.array([x for ids in got for x in ids], np.int64), np.array([len(x) for x in got], np.int64))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of the texts in them)."""
        special = np.flatnonzero(pc.fill_null(pc.match_substring(text, "<|"), False).to_numpy(zero_copy_only=False))
        hashes, offsets, starts, ends = words.hashed(text, True, _KINDS)
        hashes |= np.uint64(1)  # 0 marks a free slot
        if len(self.place) > self.most:
            self.clear()
        while True:
            slot = (hashes >> self.shift).astype(np.int64)
            at = self.slots[slot].astype(np.int64)
            missed = np.flatnonzero(self.tags[slot] != hashes)
            if len(missed):
                distinct, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
                found = np.fromiter((self.place.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
                new = np.flatnonzero(found < 0)
                if len(new):
                    data = words.raw(text)[0].tobytes()
                    where = missed[first[new]]
                    self.learn(distinct[new], [data[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                    continue
                at[missed] = found[back]
            break
        counts = self.count[at].astype(np.int64)
        to = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.first[at] - to[:-1], counts) + np.arange(to[-1])]
        to = to[offsets]
        if len(special):
            parts = np.split(ids, to[1:-1])
            for k in special:
                parts[k] = np.array(self.tokenizer.encode(text[int(k)].as_py(), add_special_tokens=False).ids, ids.dtype)
            ids, to = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, to[1:]


def assign(lengths: list[int], max_len: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    total = sum(lengths)
    full, rest = divmod(total, max_len)
    room = np.array([max_len] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)
    size, cost, out, tails, used = room.copy(), np.zeros(len(room)), [], [], 0

    def put(doc: int, start: int, n: int, at: int) -> None:
        out.append((doc, start, n, at, int(size[at] - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n if room[at] else np.inf

    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= max_len:
            put(doc, start, max_len, used)
            used, start = used + 1, start + max_len
        if start < n:
            tails.append((start - n, doc, start))
    for left, doc, start in sorted(tails):
        n = -left
        while n:
            fits = np.where(room >= n, cost, np.inf)
            at = int(fits.argmin()) if len(fits) else 0
            if fits[at] == np.inf:  # no sequence has room for all of it: fill the cheapest that has some
                at = int(cost.argmin())
            part = min(n, int(room[at]))
            put(doc, start, part, at)
            start, n = start + part, n - part
    return out


def _packed(path: str, max_len: int, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vaultframe.llm.common import pieces, tidy

        tokens = _known.get(path) or _known.setdefault(path, Tokens(path))
        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            lengths = [len(ids) for _, ids in held]
            found = assign(lengths, max_len)
            last = max((x[3] for x in found), default=-1)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d, *_ in found], pa.int64()),
                    pa.array([s for _, s, *_ in found], pa.int64()),
                    pa.array([n for _, _, n, *_ in found], pa.int64()),
                    pa.array([held[d][1][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in found], pa.binary()),
                    pa.array([lengths[d] for d, *_ in found], pa.int64()),
                    pa.array([next_id + x[3] for x in found], pa.int64()),
                    pa.array([x[4] for x in found], pa.int64()),
                ],
                schema=_ARROW,
            )
            next_id += last + 1
            held.clear()
            return out

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                ids, ends = tokens.encode(part.column("text"))
                start = 0
                for doc, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    held.append((doc, np.append(ids[start:end], ids.dtype.type(end_id))))
                    size += end - start + 1
                    start = end
                    if size >= window:
                        yield flush()
                        size = 0
                        tidy()
        if held:
            yield flush()
        tidy()

    return run


def pack(df: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, window: int = 1 << 20) -> DataFrame:
    """Pieces of the documents of df (doc_id, text): their ids as little-endian unsigned 32-bit numbers, and their place in a sequence. tokenizer: path of a `tokenizers` file that every executor has."""
    return df.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(_packed(tokenizer, max_len, end_id, window), SCHEMA)
