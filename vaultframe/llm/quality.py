"""Quality classifier: a linear-chain CRF labels every line good or bad; documents get length-weighted marginals.

A line's features are shares of kinds of characters, word lengths, repetition, and the same of the lines before and
after it. Training takes at most `sample` labelled documents (the first by a hash of doc_id) of at most `longest` characters each; texts are
scored whole. Every line first bears its document's label; then, in bad documents, lines that the model holds for good are relabelled (each keeps its
worst line) and the model is fitted again. A logistic curve, fitted on the same documents, turns the length-weighted
mean of good marginals and the share of bad lines (a tenth of the length counts wholly) into the score, a probability that the label is 1.

Empty and null texts have one empty line. Without labelled rows every score is 0.5. Rows with null doc_id or label are
not learnt from; repeated rows are scored each. A column named as an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vaultframe.llm import crf, words
from vaultframe.llm.common import parts, tidy

#: Fixed value: documents whose score is below are rejected.
THRESHOLD = 0.3
#: Kinds of bytes: lower, upper, digit, space, sentence, exclaiming, symbols, bars, other.
KINDS = 9
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 0 if "a" <= _c <= "z" or _b >= 0x80 else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c in " \t\r\v\f" else 4 if _c in ".,;:'\"()-" else 5 if _c in "!?" else 6 if _c in "#$%&*@^~=+_<>" else 7 if _c in "|\\/{}[]`" else 8


def lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, offsets of texts in lines, lengths of lines in bytes, at least 1)."""
    data, offsets = words.raw(text)
    # Each text is followed by a line break of its own.
    n = len(offsets) - 1
    flat = np.insert(data, offsets[1:], 10)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    of_text = np.searchsorted(ends, offsets[1:] + np.arange(n)) + 1
    line_offsets = np.concatenate(([0], of_text))
    size = (ends - starts).astype(np.float32)
    kind, counts = _KIND[flat], np.zeros((len(starts), KINDS), np.float32)
    for k in range(KINDS if len(starts) else 0):
        counts[:, k] = np.add.reduceat(kind == k, starts, dtype=np.int32)
    counts[:, 8] -= 1  # the line break
    part = counts / np.maximum(size, 1)[:, None]
    h, _, s, e = words.hashed(_as_text(flat))
    at = np.searchsorted(s, starts)
    to = np.append(at[1:], len(s))
    n_words = (to - at).astype(np.float32)
    line_of = np.repeat(np.arange(len(starts)), to - at)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line_of, flags, len(starts)).astype(np.float32) / np.maximum(n_words, 1)

    again = [np.concatenate((np.zeros(min(k, len(h))), (h[k:] == h[:-k]) & (line_of[k:] == line_of[:-k]))) for k in (1, 2, 3)]
    mean_word = share(e - s)
    upper_words = part[:, 1] / np.maximum(part[:, 0] + part[:, 1], 1e-3)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))
    line_hash = total[to] - total[at]
    copy = np.zeros(len(starts), np.float32)
    for k in (1, 2, 3):
        copy[k:] = np.maximum(copy[k:], (line_hash[k:] == line_hash[:-k]) & (size[k:] > 0) & (size[k:] == size[:-k]))
    copy[line_offsets[:-1]] = 0
    own = np.column_stack(
        [part, np.minimum(upper_words, 1), upper_words > 0.5, *map(share, again), copy, size == 0, np.log1p(size) / 5, np.log1p(n_words) / 4, mean_word / 10, mean_word > 14, part[:, 6] > 0.1, part[:, 5] > 0.1, part[:, 7] > 0.05, share(again[0]) > 0.5]
    ).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[line_offsets[:-1]] = 0
    after[line_offsets[1:] - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(own), np.float32)]), line_offsets, np.maximum(size, 1)


def _as_text(flat: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(flat)], np.int64)), pa.py_buffer(flat)])


@dataclass
class Model:
    weights: np.ndarray  # features x 2
    start: np.ndarray
    trans: np.ndarray
    curve: np.ndarray  # of (1, mean of good marginals, lowest good marginal)

    def marginals(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, offsets, size = lines(text)
        return crf.walk(x @ self.weights, offsets, self.start, self.trans)[:, 1], offsets, size

    def scores(self, text: pa.Array) -> np.ndarray:
        good, offsets, size = self.marginals(text)
        return _sigmoid(_summary(good, offsets, size) @ self.curve)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summary(good: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    mean = crf.sums_by(good * size, offsets) / crf.sums_by(size, offsets)
    # The share of a document's length that its bad lines must have to count wholly is a tenth.
    bad = crf.sums_by((good < 0.5) * size, offsets) / crf.sums_by(size, offsets)
    return np.column_stack([np.ones(len(mean)), mean, np.minimum(1, 10 * bad)])


def fit(texts: list[str | None], labels: list[int], rounds: int = 3, steps: int = 70) -> Model:
    if not texts:
        k = lines(pa.array([""]))[0].shape[1]
        return Model(np.zeros((k, 2), np.float32), np.zeros(2), np.zeros((2, 2)), np.zeros(3))
    x, offsets, size = lines(pa.array(texts, pa.large_string()))
    label = np.asarray(labels, np.int64)
    doc = np.repeat(np.arange(len(label)), np.diff(offsets))
    state = label[doc]
    weights, start, trans = np.zeros((x.shape[1], 2)), np.zeros(2), np.zeros((2, 2))
    for turn in range(rounds):
        up = crf.Adam(weights, start, trans, rate=0.1)
        first = offsets[:-1]
        for _ in range(steps):
            p, pair = crf.walk(x @ weights, offsets, start, trans, pairs=True)
            gap = -p.astype(np.float64)
            gap[np.arange(len(state)), state] += 1
            scale = 1 / len(state)
            up.step((x.T @ gap) * scale - 1e-5 * weights, gap[first].sum(0) * scale, (crf.gold_pairs(state, offsets, 2) - pair) * scale - 1e-4 * trans)
        if turn + 1 < rounds:
            good = crf.walk(x @ weights, offsets, start, trans)[:, 1]
            rate = np.average(state, weights=size)
            worst = np.minimum.reduceat(good, first)
            state = np.where((label[doc] == 1) | (good > 0.5 * rate) & (good > worst[doc]), 1, 0)
    model = Model(weights.astype(np.float32), start, trans, np.zeros(3))
    good, offsets, size = model.marginals(pa.array(texts, pa.large_string()))
    z, curve = _summary(good, offsets, size), np.zeros(3)
    for _ in range(60):  # Newton steps of a ridge logistic regression
        p = _sigmoid(z @ curve)
        curve += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(3), z.T @ (label - p) - 0.05 * curve)
    return Model(model.weights, start, trans, curve)


def learn(df: DataFrame, labels: DataFrame, only: Column, sample: int = 2000, longest: int = 100_000) -> Model:
    """A model of labels.quality, from at most `sample` labelled documents that fulfil `only` (on doc_id), of each at most `longest` characters."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(only).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = df.select("doc_id", F.substring("text", 1, longest).alias("text")).join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return fit([r.text for r in rows], [r.quality for r in rows])


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """df with each text's score."""

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        out = [model.scores(part) for part in parts(texts)]
        tidy()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return df.withColumn(into, scored(F.col(text).cast("string")))
