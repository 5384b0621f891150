"""Language of every word by a linear-chain CRF, for code-switched text.

A word is a run of letters (bytes of other scripts included); its features, hashed, are affixes of up to three bytes,
n-grams of two to four bytes and, as a lexicon, the word itself. Transitions are learned: training sequences are runs of
words of labelled documents, some of them joined from two languages, so that the model sees switches. Forward-backward
gives each word's marginals; their mean over a text is its mix of languages, whose largest is the prediction.

Training takes at most `sample` labelled documents of each language (the first by a hash of doc_id). A text that is null
or has no letter is `und` with score 0; so is every text where nothing was labelled. Ties go to the language first in
code-point order. Repeated rows are predicted each; a column named as an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultframe.llm import crf, words
from vaultframe.llm.common import parts, tidy

BITS = 18
_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_SPLIT = np.ones(256, bool)
for _b in range(256):
    _SPLIT[_b] = not (chr(_b).isalpha() if _b < 0x80 else True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words as numbers of distinct words, offsets of texts in words, features of distinct words' positions): see features()."""
    hashes, offsets, starts, ends = words.hashed(text, True, spaces=_SPLIT)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return number, offsets, np.column_stack([starts[first], ends[first]])


def features(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, offsets of words in them, whether a word has a letter) of words given as spans of bytes."""
    size = spans[:, 1] - spans[:, 0] + 4  # two bytes of margin on each side
    to = np.cumsum(size)
    flat = np.zeros(int(to[-1]) if len(to) else 0, np.uint8)
    inner = np.repeat(spans[:, 0] - (to - size) - 2, size) + np.arange(len(flat))
    at = np.arange(len(flat)) - np.repeat(to - size, size)
    is_char = (at >= 2) & (at < np.repeat(size, size) - 2)
    flat[is_char] = _LOWER[data[inner[is_char]]]
    v = flat.astype(np.uint64) + np.uint64(1)
    grams, keys = [], []
    word = np.repeat(np.arange(len(size)), size)
    for n in (2, 3, 4):
        g = np.zeros(len(flat), np.uint64)
        for k in range(n):
            g[: len(flat) - n + 1] = g[: len(flat) - n + 1] * np.uint64(257) + v[k : len(flat) - n + 1 + k]
        # Only grams within a word and its margins, without those of margins alone.
        ok = (at >= (1 if n < 4 else 0)) & (at + n <= np.repeat(size, size) - (1 if n < 4 else 0))
        grams.append(words.mix(g[ok] + np.uint64(n << 40)))
        keys.append(word[ok])
    sums = np.add.reduceat(words.mix(v + at.astype(np.uint64) * np.uint64(1 << 20)), to - size) if len(size) else np.zeros(0, np.uint64)
    grams.append(words.mix(sums))
    keys.append(np.arange(len(size)))
    key, gram = np.concatenate(keys), np.concatenate(grams)
    order = np.argsort(key, kind="stable")
    letter = np.bincount(word[is_char], (flat[is_char] < 0x80), len(size)) > 0 if len(size) else np.zeros(0, bool)
    for k in np.flatnonzero(~letter):
        letter[k] = any(c.isalpha() for c in data[spans[k, 0] : spans[k, 1]].tobytes().decode("utf-8", "replace"))
    return (gram[order] >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(key, minlength=len(size))))), letter


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # 2**BITS x langs
    start: np.ndarray
    trans: np.ndarray

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(text)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        number, offsets, spans = _split(text)
        emissions, has = self.emissions(words.raw(text)[0], spans)
        lettered = has[number] if len(number) else np.zeros(0, bool)
        kept = np.concatenate(([0], np.cumsum(lettered)))[offsets]
        p = crf.walk(emissions[number[lettered]], kept, self.start, self.trans)
        mean = crf.sums_by(p, kept) / np.maximum(np.diff(kept), 1)[:, None]
        best = mean.argmax(1)
        some = np.diff(kept) > 0
        return [self.langs[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, np.minimum(mean[np.arange(n), best], 1), 0.0)

    def emissions(self, data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each distinct word, in parts to bound memory, and whether it has a letter."""
        out, has = np.zeros((len(spans), len(self.langs)), np.float32), np.zeros(len(spans), bool)
        for k in range(0, len(spans), 8192):
            part = spans[k : k + 8192]
            f, to, has[k : k + 8192] = features(data, part)
            out[k : k + 8192] = np.add.reduceat(self.weights[f], to[:-1], axis=0)
        return out, has


def fit(texts: list[str], langs: list[str], length: int = 60, rounds: int = 6, switched: float = 0.3, seed: int = 5) -> Model:
    """A model from whole labelled texts: runs of `length` words are the sequences; a share of them is joined from halves of two."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    text, rng, k = pa.array(texts, pa.large_string()), np.random.default_rng(seed), len(names)
    number, offsets, spans = _split(text)
    f, to, has = features(words.raw(text)[0], spans)
    label = np.array([names.index(x) for x in langs])
    runs, states = [], []
    for d in range(len(texts)):
        own = number[offsets[d] : offsets[d + 1]]
        own = own[has[own]]
        for s in range(0, len(own), length):
            runs.append(own[s : s + length])
            states.append(np.full(len(runs[-1]), label[d]))
    weights, start, trans = np.zeros((1 << BITS, k), np.float32), np.zeros(k), np.zeros((k, k))
    heat, small = np.full(1 << BITS, 1e-3, np.float32), crf.Adam(start, trans, rate=0.05)
    for _ in range(rounds):
        order = rng.permutation(len(runs))
        for b in range(0, len(order), 128):
            seqs, golds = [], []
            for i in order[b : b + 128]:
                seq, gold = runs[i], states[i]
                if rng.random() < switched:
                    j = rng.integers(len(runs))
                    m, n = len(seq) // 2 + 1, len(runs[j]) // 2 + 1
                    seq, gold = np.concatenate((seq[:m], runs[j][:n])), np.concatenate((gold[:m], states[j][:n]))
                seqs.append(seq)
                golds.append(gold)
            at, gold = np.concatenate(seqs), np.concatenate(golds)
            where = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
            if not len(at):
                continue
            distinct, back = np.unique(at, return_inverse=True)
            counts = to[distinct + 1] - to[distinct]
            ends = np.cumsum(counts)
            fs = f[np.repeat(to[distinct] - (ends - counts), counts) + np.arange(ends[-1])]
            e = np.add.reduceat(weights[fs], ends - counts, axis=0)[back]
            p, pair = crf.walk(e, where, start, trans, pairs=True)
            gap = -p
            gap[np.arange(len(gold)), gold] += 1
            by_word = np.zeros((len(distinct), k), np.float32)
            np.add.at(by_word, back, gap)
            spread = np.repeat(by_word, counts, axis=0)
            touched, index = np.unique(fs, return_inverse=True)
            grad = np.column_stack([np.bincount(index, spread[:, c], len(touched)) for c in range(k)]).astype(np.float32)
            heat[touched] += (grad * grad).sum(1)
            weights[touched] += 0.1 * grad / np.sqrt(heat[touched])[:, None]
            first = where[:-1][np.diff(where) > 0]
            small.step(gap[first].sum(0, dtype=np.float64) / len(first), (crf.gold_pairs(gold, where, k) - pair) / len(gold) - 1e-4 * trans)
    return Model(names, weights, start, trans)


def learn(df: DataFrame, only: Column, sample: int = 150, longest: int = 100_000) -> Model:
    """A model of df.lang, from at most `sample` documents of each language that fulfil `only` (on doc_id), of each at most `longest` characters."""
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order)) <= sample
    rows = df.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null").filter(only)
    some = rows.withColumn("k", first(F.xxhash64("doc_id"), "doc_id")).filter("k").drop("k").distinct()
    texts = df.select("doc_id", F.substring("text", 1, longest).alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null")
    got = texts.join(F.broadcast(some), ["doc_id", "lang"]).withColumn("k", first(F.xxhash64("doc_id"), "doc_id", "text")).filter("k").orderBy("lang", F.xxhash64("doc_id"), "doc_id", "text").collect()
    return fit([r.text for r in got], [r.lang for r in got])


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BITS weights for each language

    @F.arrow_udf(_PREDICTED)
    def predicted(texts: pa.Array) -> pa.Array:
        lang, score = [], [np.zeros(0)]
        for part in parts(texts, 2 << 20):
            got = shared.value.predict(part)
            lang += got[0]
            score.append(got[1])
        tidy()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score), pa.float64())], ["lang_pred", "score"])

    df = df.drop("lang_pred", "score")
    found = predicted(F.col(text).cast("string"))
    return df.select(*df.columns, found.alias("__predicted")).select(*df.columns, "__predicted.lang_pred", "__predicted.score")
