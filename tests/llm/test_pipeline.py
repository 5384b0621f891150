"""The pipeline on the smallest tables, against plain versions of what its stages decide."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vaultframe.llm import pii
from vaultframe.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:-1])


def test_decisions(stages, spark, sf):
    raw, good, distinct, private, mixed, packed = stages
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(good.doc_id)
    clean = [i for i in labels.index if labels[i] == 1]
    assert np.mean([i in kept for i in clean]) > 0.95 and set(distinct.doc_id) <= kept
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    sets = [shingles(t) for t in distinct.text]
    for i in range(len(sets)):
        for j in range(i):
            assert len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
    gone = good[~good.doc_id.isin(distinct.doc_id)]
    assert all(any(len(shingles(t) & s) >= 0.8 * len(shingles(t) | s) for s in map(shingles, good.text[good.doc_id < i])) for i, t in zip(gone.doc_id, gone.text, strict=True))
    assert list(private.doc_id.sort_values()) == list(distinct.doc_id.sort_values())
    assert not any(x["kind"] in pii.BASE for t in private.text for x in pii.spans(t))
    assert set(mixed.doc_id) <= set(private.doc_id)
    total = sum(len(t.split()) for t in private.text)
    assert abs(sum(len(t.split()) for t in mixed.text) - 1.5 * total) <= private.source.nunique() + 1
    assert set(packed.doc_id) == set(mixed.doc_id)
    fill = packed.groupby("sequence_id").length.sum()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill)


def test_entry():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")}
    assert pa is not None and "pipeline" in __spark_entry__.queries()
