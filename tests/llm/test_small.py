"""Operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from vaultframe.llm import ann, components, crf, html, language, mixing, ngram_join, packing, pii, quality, repeats, topk, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, start int, words string, pii string, n int"


def docs(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1.0, "x", 1, "y", "z", 2) for i, t, s in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words():
    text = ["the quick  Brown\tfox", None, "", "quick\nthe", "x" * 3_000_000 + " é", " a"]
    h, o, _, _ = words.hashed(pa.array(text))
    assert np.diff(o).tolist() == [len(WORD.findall(t or "")) for t in text]
    assert h[0] == h[5] and h[1] == h[4]
    low, _, _, _ = words.hashed(pa.array(["Ab É", "aB é"]), lower=True)
    assert low[0] == low[2] and low[1] != low[3]
    runs = words.runs(np.array([1, 2, 3, 1, 2, 3, 4], np.uint64), 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 4 and len(words.runs(runs, 99)) == 0


def test_words_of_patterns():
    for n in (7, 8, 9, 16, 63, 64, 65, 1024, 4096):
        thue = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        other = thue.translate(str.maketrans("ab", "ba"))
        text = [thue, other, thue + "a", thue, thue[:-1] + "c", "a" * n, "a" * (n + 1), "x " + thue + "\n" + other]
        h, o, _, _ = words.hashed(pa.array(text))
        assert h[0] == h[3] == h[8] and h[1] == h[9] and len(set(h.tolist())) == len({w for t in text for w in t.split()})


def test_joined_words():
    rng = np.random.default_rng(12)
    text = ["".join(rng.choice(list("ab é\t\n 漢"), int(rng.integers(0, 30)))) for _ in range(400)] + [None, "", " "]
    h, o, s, e = words.hashed(pa.array(text))
    flat, to = words.joined(words.raw(pa.array(text))[0], o, s, e)
    assert [flat[a:b].tobytes().decode() for a, b in zip(to[:-1], to[1:], strict=True)] == [" ".join(WORD.findall(t or "")) for t in text]


# 1

def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([10, 1000], [3, 1], 1.5, 2) == [20, 1495]
    assert mixing.targets([0, 10], [3, 1], 1.5, 2) == [0, 15]
    for n in (1, 2, 7, 100, 1000):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permuted(p, n, 5, back=True) == np.arange(n)).all()


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), f"s{i % 3}") for i in range(120)] + [(500, None, None), (501, "a b c", None), (7, "x y", "s1"), (7, "x y", "s1"), (None, "n", "s2"), (502, "z " * 30_000, "s0")]
    df = docs(spark, rows)
    got = mixing.taken(df, seed=3).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [3, 1, 2, 3], 1.5, 2), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r["size"] and r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in order)
    again = mixing.taken(df.repartition(5), seed=3).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, ((r.doc_id, r["size"], r.taken) for r in got))) == sorted(map(str, map(tuple, again)))
    texts = mixing.documents(df, seed=3)
    assert texts.columns == df.columns
    by = defaultdict(int)
    for r in texts.collect():
        by[r.doc_id, r.source] += len(WORD.findall(r.text))
    assert {k: v for k, v in by.items() if v} == {k: v for k, v in defaultdict(int, ((k, sum(r.taken for r in got if (r.doc_id, r.source) == k)) for k in {(r.doc_id, r.source) for r in got})).items() if v}
    assert mixing.taken(empty(spark)).collect() == [] and mixing.documents(empty(spark)).collect() == []


# 2

def sets_of(rows, k):
    out = []
    for _, t, _ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def components_of(rows, k, num, den):
    sets, label = sets_of(rows, k), list(range(len(rows)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 62)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def near_rows():
    rng = np.random.default_rng(4)
    def word():
        return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 4))
    passage, rows, n = [word() for _ in range(12)], [], 0
    for size in (3, 8, 30, 120, 300):
        base = [word() for _ in range(size)]
        for copy in range(30):
            w = list(base)
            for _ in range(copy % 5):
                w[int(rng.integers(0, size))] = word()
            rows.append((n, " ".join(w), "s"))
            n += 1
    for _ in range(40):
        rows.append((n, " ".join(passage + [word() for _ in range(int(rng.integers(0, 40)))]), "s"))
        n += 1
    rows += [(n, None, "s"), (n + 1, "", "s"), (n + 2, " \n ", "s"), (n + 3, "Two words", "s"), (n + 4, "two WORDS", "s"), (n + 5, "one", "s"), (n + 6, "É x", "s"), (n + 7, "é x", "s"), (n + 8, "q " * 50_000, "s")]
    return rows + [rows[0], rows[40]]


@pytest.mark.parametrize(("k", "num", "den", "rare", "few"), [(3, 90, 100, 8, 32), (5, 80, 100, 2, 4)])
def test_ngram_join(spark, monkeypatch, k, num, den, rare, few):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = near_rows()
    got = ngram_join.classes(docs(spark, rows), k, num, den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components_of(rows, k, num, den)


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """Texts that differ a little too much, but for twins: what their group writes grows with its nodes, not with their pairs."""
    apply = GroupedData.applyInArrow
    def joined(c):
        rng = np.random.default_rng(c)
        rows = [(i, " ".join([f"w{k}" for k in range(100) if k != i % 100] + [f"own{i}x{k}" for k in range(5)]), "s") for i in rng.permutation(c).tolist()]
        total = spark.sparkContext.accumulator(0)
        def counted(self, run, schema):
            def of(key, rows):
                out = run(key, rows)
                total.add(out.num_rows if len(key) == 3 else 0)
                return out
            return apply(self, of, schema)
        monkeypatch.setattr(GroupedData, "applyInArrow", counted)
        got = ngram_join.classes(docs(spark, rows), 1)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components_of(rows, 1, 90, 100)
        return total.value
    assert joined(100) <= 10 * 100 and joined(300) <= 10 * 300
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # a row is in a group for each block
    assert joined(120) <= 10 * 120 * 8


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "s"), (3, "A b c d e f", "s"), (3, "A b c d e f", "s"), (9, None, "s"), (9, None, "s"), (8, "other words here now", "s")]
    got = ngram_join.keep_one(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(3, "A b c d e f"), (8, "other words here now"), (9, ""), (9, "")]
    assert ngram_join.keep_one(empty(spark)).collect() == [] and ngram_join.classes(empty(spark)).collect() == []


def test_null_ids(spark):
    base = [f"w{k}" for k in range(60)]
    middle = " ".join(["x0", *base[1:]])  # links with both, which do not link with each other
    left, right = " ".join(["x0", *base[1:30], "y", *base[31:]]), " ".join(base)
    rows = [(5, left, "s"), (None, middle, "s"), (7, right, "s"), (9, "other words here now and then", "s"), (None, "nothing like it at all", "s"), (None, "nothing like it at all", "s")]
    sets = sets_of(rows, 3)
    def alike(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert min(alike(0, 1), alike(1, 2)) >= 0.9 > alike(0, 2)
    got = ngram_join.classes(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (5, 5), (7, 5), (9, 9)]
    got = ngram_join.keep_one(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, rows[4][1]), (5, left), (9, rows[3][1])]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 0, 200: 200, 201: 200}


@pytest.mark.parametrize("links", [[], [(-5, -5)], [(999, i) for i in range(50)], [(999, i) for i in range(0, 50, 2)] + [(-1000, i) for i in range(1, 50, 2)] + [(48, 49)], [(int(a), int(b)) for a, b in np.random.default_rng(5).integers(-60, 60, (70, 2))]])
def test_components_against_a_plain_version(spark, links):
    """A hub with the largest name, two hubs with a bridge, random links, none."""
    plain = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in plain:
        for a, b in links:
            if a != b:
                plain[a] = plain[b] = min(plain[a], plain[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(plain) and {r.node: r.component for r in got} == plain


# 3 and 7

VECTORS = "vec_id long, embedding array<float>, label int, vec string, id int, score double"


def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12))]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]
    return rows + [(460, None), (461, [0.0] * 12), (462, [1.0] * 11 + [float("nan")]), (463, [float("inf")] * 12), (464, [1.0, None] * 6), (465, []), (466, [1.0, 2.0]), (500, [2.0, 4.0]), (None, [1.0] * 12)]


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2, 0.5) for i, v in rows], VECTORS).repartition(3)


def brute(rows, score):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in sound:
        if q % 50 == 0:
            found = sorted(((-s, i) for i, b in sound if i != q and len(a) == len(b) and (s := score(a, b)) is not None))
            out[q] = [(i, -s) for s, i in found[:5]]
    return out


def answers(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


def test_topk(spark):
    rows = vector_rows()
    want = brute(rows, lambda a, b: int(np.dot(np.floor(256 * np.array(a, float)), np.floor(256 * np.array(b, float)))))
    assert answers(topk.search(table_of(spark, rows), F.col("vec_id") % 50 == 0, block=64)) == want
    assert topk.search(table_of(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_pivots_stop_early():
    x = np.random.default_rng(0).normal(size=(5000, 2)) * 1000 // 1
    pivots = x[:32]
    away = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)
    at, scores, done = topk.search_block(x[7], away[7], x, away, (x * x).sum(1), np.arange(5000), True, chunk=64)
    s = (x @ x[7]).astype(int)
    assert at.tolist() == np.lexsort((np.arange(5000), -s))[:6].tolist() and scores.tolist() == s[at].tolist() and done < 2500


def test_pivots_give_a_threshold():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 6)))
    pivots = x[:64]
    away = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)
    for k in range(0, 3000, 300):
        s = np.sort(x @ x[k])[::-1]
        least = topk.threshold(x[k], away[k], (pivots * pivots).sum(1))
        assert least <= s[5] and least >= np.sort(pivots @ x[k])[-6] - 2


def test_ann(spark):
    rows = vector_rows()
    def cosine(a, b):
        x, y = np.array(a, float), np.array(b, float)
        return None if not x.any() or not y.any() else float(x @ y / np.sqrt((x @ x) * (y @ y)))
    want = {q: v for q, v in brute(rows, cosine).items()}
    got = answers(ann.search(table_of(spark, rows), F.col("vec_id") % 50 == 0))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [i for i, _ in got[400]] == [3, 401, 402, 403, 404] and got[500] == [(466, pytest.approx(1.0))]
    assert ann.search(table_of(spark, []), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize(("dim", "n"), [(64, 9), (1024, 12), (256, 4)])
def test_ann_of_few_vectors(spark, dim, n):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=dim))]) for i in range(n)]
    got = answers(ann.search(table_of(spark, rows), F.col("vec_id") >= 0))
    for q, v in rows:
        score = {i: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for i, w in rows if i != q}
        assert len({i for i, _ in got[q]}) == min(5, n - 1) and all(s == pytest.approx(score[i]) for i, s in got[q])


@pytest.mark.parametrize(("part", "per"), [(4096, 25), (8, 25), (16, 8)])
def test_ann_of_many_buckets(spark, part, per):
    """Recall as the query runs it, with 64 dimensions, and with crowded buckets cut to parts; answers stay exact cosines."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    x = np.float32(np.concatenate([rng.normal(size=(1500, 64)), centre + 0.1 * rng.normal(size=(500, 64))]))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = answers(ann.search(table_of(spark, rows), F.col("vec_id") % 50 == 0, part=part, per=per))
    wide = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 2000, 50):
        s = wide @ wide[q]
        s[q] = -9
        hits += len({i for i, _ in got[q]} & set(np.argsort(-s, kind="stable")[:5].tolist()))
        assert len(got[q]) == 5 and all(v == pytest.approx(s[i]) for i, v in got[q])
    assert hits >= 0.9 * 200


def test_ann_recall_on_table(spark):
    from vaultframe.llm.queries import op3_neighbours

    sf = "/root/testdata/sf0.01"
    got = answers(op3_neighbours(spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in sound]), np.array([v / np.linalg.norm(v) for _, v in sound])
    hits = [len({i for i, _ in got[q]} & set(ids[np.argsort(-np.where(ids == q, -9, x @ x[k]), kind="stable")[:5]].tolist())) for k, q in enumerate(ids.tolist()) if q % 50 == 0]
    assert np.mean(hits) >= 4.5


@pytest.mark.parametrize("search", [ann.search, topk.search])
def test_repeated_rows(spark, search):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(40)]
    asked = F.col("vec_id") % 10 == 0
    want = answers(search(table_of(spark, rows), asked))
    assert answers(search(table_of(spark, rows + [rows[0]] * 6 + [rows[10]] + [rows[i] for i in range(1, 40)]), asked)) == want
    assert all(len(x) == 5 for x in want.values())


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 12))
    y = ann.rotated(x, 0, 3)
    assert y.shape == (5, 16) and np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(y @ y.T, x @ x.T)


# 4 and 6

@pytest.mark.parametrize("k", [2, 3])
def test_forward_backward_by_enumeration(k):
    """Marginals and sums of pairs against all paths, for sequences of 0 to 5 positions at once."""
    rng = np.random.default_rng(k)
    lengths = [5, 0, 1, 4, 2]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    e, start, trans = rng.normal(size=(offsets[-1], k)), rng.normal(size=k), rng.normal(size=(k, k))
    want, pairs = np.zeros_like(e), np.zeros((k, k))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        paths = list(itertools.product(range(k), repeat=b - a)) if b > a else []
        weight = np.array([np.exp(start[p[0]] + sum(e[a + t, x] for t, x in enumerate(p)) + sum(trans[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        for p, w in zip(paths, weight / weight.sum() if paths else [], strict=True):
            for t, x in enumerate(p):
                want[a + t, x] += w
            for x, y in itertools.pairwise(p):
                pairs[x, y] += w
    got, sums = crf.walk(e, offsets, start, trans, pairs=True)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(sums, pairs, atol=1e-3)
    assert np.allclose(crf.walk(e, offsets, start, trans), want, atol=1e-4)
    states = rng.integers(0, k, offsets[-1])
    gold = np.zeros((k, k))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for x, y in itertools.pairwise(states[a:b].tolist()):
            gold[x, y] += 1
    assert (crf.gold_pairs(states, offsets, k) == gold).all()


def test_classifiers_on_long_texts_ties_and_empty_tables(spark):
    long = "the of and to in that was " * 100_000
    m = language.fit(["the of and to in that was"] * 20 + ["der die und nicht ist das ein"] * 20, ["en"] * 20 + ["de"] * 20)
    df = docs(spark, [(1, long, "s"), (2, "x" * 1_000_000, "s"), (2, "the of", "s"), (2, "the of", "s")]).withColumn("lang_pred", F.lit("mine"))
    got = language.predict(df, m).collect()
    assert len(got) == 4 and {r.lang_pred for r in got if r.text in (long, "the of")} == {"en"}
    tie = language.fit(["a b c"] * 4, ["xx", "aa", "xx", "aa"])
    assert tie.predict(pa.array(["a b c"]))[0][0] in ("aa", "xx")
    assert language.predict(empty(spark), m).collect() == [] and language.learn(empty(spark), F.lit(True)).langs == []
    q = quality.fit(["Is and the of, this was said."] * 20 + ["BUY!! NOW!!"] * 20, [1] * 20 + [0] * 20)
    assert all(0 <= r.score <= 1 for r in quality.score(df, q).collect())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(df, quality.learn(df, labels, F.lit(True))).select("score").distinct().count() == 1


def test_language():
    m = language.fit(["the of and to in that was"] * 20 + ["der die und nicht ist das ein"] * 20, ["en"] * 20 + ["de"] * 20)
    lang, score = m.predict(pa.array(["THE of and", "und die nicht", None, "", "12 !!", "—", "the of and to in that was der die und nicht ist das ein das ein"]))
    assert lang == ["en", "de", "und", "und", "und", "und", "de"] and score[2] == 0 and 0.4 < score[6] < 0.75
    none = language.fit([], [])
    assert none.predict(pa.array(["x"]))[0] == ["und"]


def test_language_held_out(spark, sf):
    from vaultframe.llm.queries import op4_language

    got = op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_quality():
    good, bad = "Is and the of, this was said.\nThen it was so. More came.", "BUY!! NOW!! CHEAP!! NOW!!\n### $$$ &&& ***"
    m = quality.fit([good] * 30 + [bad] * 10, [1] * 30 + [0] * 10)
    s = m.scores(pa.array([good, bad, None, "", good + "\n" + bad, good * 2000]))
    assert s[0] > 0.9 and s[1] < 0.1 and ((s >= 0) & (s <= 1)).all() and s[5] > 0.9
    assert quality.fit([], []).scores(pa.array(["x"])).tolist() == [0.5]


def test_quality_held_out(spark):
    from vaultframe.llm.queries import op6_quality

    sf = "/root/testdata/sf0.01"
    got = op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_classifiers_keep_rows(spark):
    df = docs(spark, [(1, None, "s"), (1, None, "s"), (2, "", "s")])
    got = quality.score(df, quality.fit([], [])).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5}
    got = language.predict(df, language.fit([], [])).collect()
    assert len(got) == 3 and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert quality.score(empty(spark), quality.fit([], [])).collect() == []


# 5

def plain_repeats(rows, n):
    seen, out = {}, []
    texts = sorted((i, WORD.findall(t or "")) for i, t, _ in rows)
    for i, w in texts:
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), (i, k))
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] < (i, k):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


def test_repeats(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(500)]
    def some(n):
        return [vocabulary[int(k)] for k in rng.integers(0, 500, n)]
    passages, rows = [some(k) for k in (25, 60, 20)], []
    for i in range(60):
        w = some(int(rng.integers(0, 150)))
        if i % 3 == 0:
            w += passages[i % 9 // 3] + some(5)
        if i % 7 == 0:
            w += w[-30:] + w[-30:]
        rows.append((i, " ".join(w), "s"))
    rows += [(100 + i, rows[i][1] + "\n", "s") for i in (0, 9, 21)] + [(200, None, "s"), (201, "", "s"), (202, "a " * 5000, "s"), (203, " ".join(passages[1]), "s")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.digest(docs(spark, rows)).collect())
    assert got == plain_repeats(rows, 20)
    twice = [(1, "x " * 30, "s"), (1, "x " * 30, "s")]  # rows of one doc_id leave each other's first window
    assert [r.n_removed for r in repeats.digest(docs(spark, twice)).collect()] == [29, 29]
    assert repeats.digest(empty(spark)).collect() == []


def test_repeats_of_texts_with_like_hashes(spark):
    passage, first = " ".join(f"p{k}" for k in range(25)), {}
    for k in range(5000):
        text = f"{passage} x{k}"
        h, offsets, _, _ = words.hashed(pa.array([text]))
        other = first.setdefault(int(repeats._sequences(h, offsets)[0]) & 0xFFFF, text)
        if other != text:
            break
    rows = [(1, other, "s"), (2, text, "s")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.digest(docs(spark, rows)).collect())
    assert got == plain_repeats(rows, 20) and got[1][2] == 25


# 8

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(BASE).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii(spark):
    rng = np.random.default_rng(9)
    rows = [(k, "".join(rng.choice(list("ab1204. @-+()%_éX\n"), int(rng.integers(0, 60)))), "s") for k in range(1500)]
    rows += [(2000, "a@b.com_x@y.org mail a@b..c @x.y %@z.z. 1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 4111 1111-1111 1111 +49 (30) 123-4567 8", "s"), (2001, None, "s"), (2001, "", "s"), (2002, "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789", "s"), (2003, "1" * 50_000 + "@" + "." * 50_000, "s"), (2004, "ssn? 987-65-4321 4012888888881881", "s")]
    got = pii.digest(pii.detect(docs(spark, rows)))
    by = {(r.doc_id, r.base_sha256) for r in got.collect()}
    assert by == {(i, hashlib.sha256(plain_pii(t).encode()).hexdigest()) for i, t, _ in rows}
    one = got.filter("doc_id = 2002").first()
    assert one.spans == "iban:5:32,ssn:38:49" and (one.n_email, one.n_ip, one.n_card, one.n_phone) == (0, 0, 0, 0)
    red = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).filter("doc_id in (2001, 2002)").collect()}
    assert red[2002].endswith("ssn [SSN]") and pii.detect(empty(spark)).collect() == []


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("DE89370400440532013000 EUR 100", ["DE89370400440532013000"]), ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
        ("NO9386011117947 GB82 WEST 1234 5698 7654 32 OK", ["NO9386011117947", "GB82 WEST 1234 5698 7654 32"]), ("AB12 REF 4711 TO DE89370400440532013000 X", ["DE89370400440532013000"]),
        ("DE89370400440532013001 EUR 100", []), ("DE89370400440532013000EUR", []),
    ],
)
def test_iban_before_other_words(text, want):
    assert [text[x["start"] : x["end"]] for x in pii.spans(text) if x["kind"] == "iban"] == want


# 9

@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>Short</p>", "Short"),
        ("<html><body><header>H</header><nav><a href=x>m</a></nav><article><h1>T &amp; t</h1><p>a\n b&nbsp;<b>c</b>d<br>e<p>f &lt; g<script>var x='</p>';</script><div class='share x'>no</div></article><footer>F</footer>", "T & t\na b cd\ne\nf < g"),
        ("<body><div id=nav class='site-nav'>menu</div><div class=content><h2>Head</h2><p>First, with text. And more, too.</p><ul><li>one, two.<li>three</ul></div><aside>s</aside><form>f<input></form><div class='comments'><p>Nice, one. Yes.</p></div>", "Head\nFirst, with text. And more, too.\none, two.\nthree"),
        ("<article><p>Kept.<!-- no --><style>p{}</style></p><article class=comment><p>Not this, no.</p></article><p>Cut off &am", "Kept.\nCut off &am"),
        ("<main><p>One<table><tr><td>a<td>b</table></main><p>Outside, of it.", "One\na\nb"),
        ("<p title=\"a>b\">x < y <3 & z</p><", "x < y <3 & z\n<"),
    ],
)
def test_html(page, want):
    assert html.main_text(page) == want


def test_html_is_linear():
    """Nested, unmatched and unclosed tags cost no more than in proportion."""
    def seconds(n):
        begun = time.perf_counter()
        for page in ("<div>" * n + "x", "<b>" * n + "</u>" * n, "<u><article>" + "<b>" * n + "</u>" * n, "<div class=nav>" * n + "t" + "</div>" * n, "<b>" * n + "<h1>x" * n):
            html.main_text(page)
        return time.perf_counter() - begun
    seconds(1000)
    assert seconds(40_000) < 30 * max(seconds(4000), 0.05)


def test_html_ratios_decide():
    """Without lists of marks or an article, paths of text are told from paths of links by their ratios alone."""
    body = "".join(f"<p>Paragraph {k} says a thing, and then another. It goes on for a while, too.</p>" for k in range(8))
    links = "".join(f"<p><a href=/{k}>Go to {k}</a></p>" for k in range(30))
    got = html.main_text(f"<body><div class=x>{links}</div><div class=y>{body}</div>")
    assert got.count("Paragraph") == 8 and "Go to" not in got
    fused, linked = html.scores(*html.blocks(f"<body><div class=x>{links}</div><div class=y>{body}</div>"))
    assert len(fused) == 2 and sorted(linked.values()) == [False, True]


def test_html_deep_links():
    p = "".join(f"<p>Paragraph {k} says a thing, and then another.</p>" for k in range(8))
    deep = "<p><a href=x><span><b><i><u><em>Deeply linked words, many of them</em></u></i></b></span></a></p>"
    assert "Deeply" not in html.main_text(f"<body><div class=y>{p}</div><div class=x>{deep}</div>")


def test_html_scores_decide_beside_articles():
    body = "".join(f"<p>Paragraph {k} says a thing, and then another. It goes on for a while.</p>" for k in range(12))
    cards = "".join(f"<article><a href=/{k}>Card {k}</a></article>" for k in range(4))
    got = html.main_text(f"<body><div class=story>{body}</div>{cards}")
    assert got.count("Paragraph") == 12 and "Card" not in got
    plain = "<article>A teaser, in short.</article>"
    assert html.main_text(f"<body><div class=story>{body}</div>{plain}").count("Paragraph") == 12
    links = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(6))
    got = html.main_text(f"<body><article>{body}<ul>{links}</ul></article><div>Outside, of it.</div>")
    assert got.count("Paragraph") == 12 and "Link" not in got and "Outside" not in got


def test_html_headings_and_cells():
    p = "".join(f"<p>Paragraph {k} says a thing, and then another. It goes on for a while, too.</p>" for k in range(4))
    row = "".join(f"<tr><td>{k}</td><td>{k + 1}</td></tr>" for k in range(3))
    got = html.main_text(f"<body><nav>menu</nav><div id=x><h1>A title</h1><h2>So</h2>{p}<ul><li>a</li><li><b>b</b></li></ul><table>{row}</table></div><ul><li><a href=x>All</a></li></ul><footer>f</footer>")
    assert got.split("\n")[:2] == ["A title", "So"] and got.endswith("too.\na\nb\n0\n1\n1\n2\n2\n3")


@pytest.mark.parametrize("name", ["content has-sidebar", "elementor-widget-wrap", "w-1/2 no-comments"])
def test_html_marked_wrappers(name):
    p = "".join(f"<p>Paragraph {k} says a thing, and then another.</p>" for k in range(4))
    want = "\n".join(f"Paragraph {k} says a thing, and then another." for k in range(4))
    rest = "<div class=sidebar>Aside, of it.</div><div class=comments><p>Nice, one.</p></div>"
    assert html.main_text(f"<body><div class='{name}'><article>{p}</article>{rest}</div>") == want
    assert html.main_text(f"<body><div class='{name}'><div class=inner>{p}</div></div><nav>m</nav>") == want
    assert html.main_text(f"<body><article>{p}</article><div class=comments>{p}{p}</div>") == want


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>x", "t"), (1, "<p>x", "t"), (2, None, "t"), (3, "<div>" * 3000 + "deep", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html.extract(df).collect()) == [(1, "x"), (1, "x"), (2, ""), (3, "deep")]


# 10

def test_assign():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 300):
        lengths = [int(x) for x in rng.integers(1, 5000, n)]
        got = packing.assign(lengths, 2048)
        by = defaultdict(list)
        for d, s, k, q, o in got:
            by[q].append((o, k))
        for parts in by.values():
            at = 0
            for o, k in sorted(parts):
                assert o == at and k > 0
                at += k
            assert at <= 2048 and at & (at - 1) == 0
        assert sum(p[1] for x in by.values() for p in x) == sum(lengths)
        for d in range(n):
            at = 0
            for s, k in sorted((s, k) for e, s, k, _, _ in got if e == d):
                assert s == at
                at += k
            assert at == lengths[d]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Don't stop, it's x's", "<|endoftext|>a b", None, "", "Ábc É naïve—. a.b,c!!d 1a2", "漢字 ½ ² İstanbul ΑΣ", "long word " * 4000, "x", "á \x1f b", "a'sB'S"]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(7, "x", "s")]
    got = packing.pack(docs(spark, rows), path, window=5000).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = [x for r in sorted(parts[k], key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert mine == ids * (2 if k == 7 else 1) and all(r.doc_tokens == len(ids) for r in parts[k])
    assert packing.pack(empty(spark), path).collect() == []
