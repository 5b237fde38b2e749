"""The quality network: context vectors against a plain loop, held-out accuracy, edges."""

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import quality, text

SF = "/root/testdata/sf0.01"


def test_context_vectors_against_a_plain_loop(spark):
    texts = ["the cat sat on the mat. 12 12", "", None, "A dog SAT", "the cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    place, sign = quality.index_vectors()
    want = np.zeros((quality.WORDS, quality.DIM))
    for t in texts:
        ids = quality.word_ids(text.units(pa.array([t], pa.string()))).tolist()
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    want[w, place[ids[j]]] += sign[ids[j]]
    assert np.array_equal(quality.context_vectors(df), want)


def test_pooling_is_the_mean_of_word_vectors():
    v = np.random.default_rng(0).normal(size=(quality.WORDS, quality.DIM)).astype(np.float32)
    col = pa.array(["one two three two", None, "", "X Y. " * 9000])
    got = quality.pooled(col, v)
    c = text.units(col)
    ids = quality.word_ids(c)
    for d in range(len(col)):
        own = v[ids[c.ptr[d]:c.ptr[d + 1]]]
        want = own.astype(np.float64).mean(0) if len(own) else np.zeros(quality.DIM)
        assert np.allclose(got[d, :quality.DIM], want, atol=1e-3)


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / n / (len(y) - n)


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.predict(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert auc(np.array([r.score for r in held]), np.array([r.quality for r in held])) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "word"), (5, "x" * 200_000), (6, "SHOUT " * 20_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double")
    one = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, 0, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    none = quality.fit(df, one.limit(0))
    assert {r.score for r in quality.predict(df, none).collect()} == {0.5}
    out = quality.predict(df, quality.fit(df, one)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.predict(df.limit(0), none).count() == 0
    assert not quality.context_vectors(df.limit(0)).any()
