"""Near duplicates, against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import graph, simhash

SCHEMA = "doc_id bigint, text string, lang string, class_id string"


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    docs = []
    for _ in range(n):
        if docs and rng.random() < 0.4:
            w = rng.choice(docs[-60:]).split()
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 200))]
        docs.append(" ".join(w))
    return docs


def brute(texts):
    distinct = sorted(set(t for t in texts if t is not None))
    sig, has = simhash.signatures(pa.array(distinct))
    d = simhash.distance(sig[:, None, :4], sig[None, :, :4])
    full = simhash.distance(sig[:, None], sig[None])
    near = (d <= simhash.NEAR) & (full <= simhash.NEAR_ALL) & has[:, None] & has[None]
    np.fill_diagonal(near, False)
    return distinct, near


def test_groups_against_all_pairs(spark):
    texts = corpus() + [None, None, "", "", "!!", "!!", "one"]
    df = spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in simhash.groups(df).collect()}
    assert len(rows) == len(texts)
    distinct, near = brute(texts)
    place = {t: k for k, t in enumerate(distinct)}
    found = sum(rows[i].n_links for i in {t: i for i, t in enumerate(texts) if t is not None}.values())
    assert near.sum() > 100
    assert 0.95 * near.sum() <= found <= near.sum()
    # No link that isn't one, and groups are the components of the links, or parts of them.
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        parent[find(a)] = find(b)
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].class_id == i and rows[i].n_links == 0
            continue
        c = rows[i].class_id
        assert c <= i and find(place[t]) == find(place[texts[c]])
        assert rows[i].n_links <= near[place[t]].sum()
        assert rows[i].n_copies == texts.count(t)


@pytest.mark.parametrize("cap, dense", [(1 << 17, 1 << 13), (40, 7), (1 << 17, 7), (5, 1 << 13)])
def test_oversized_buckets_lose_nothing(spark, cap, dense):
    """Every close pair that meets in a table counts once, however buckets are cut."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (3, 8), dtype=np.uint64)
    sig = np.concatenate([np.repeat(base[:1], 240, 0), np.repeat(base[1:], 30, 0)])
    for _ in range(9):
        sig[np.arange(300), rng.integers(0, 8, 300)] ^= np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)
    tables, near, near_all = simhash.tables_for(300), 9, 14
    bits = simhash._bits(sig)
    shared = tables.shared_keys(bits)
    meet = np.zeros((300, 300), bool)
    for g in range(shared.shape[1]):
        for u in range(simhash.IN_GROUP):
            own = tables.own_keys(bits, np.full(300, g * simhash.IN_GROUP + u))
            meet |= (shared[:, None, g] == shared[None, :, g]) & (own[:, None] == own[None])
    close = (simhash.distance(sig[:, None, :4], sig[None, :, :4]) <= near) & (simhash.distance(sig[:, None], sig[None]) <= near_all)
    weight = rng.integers(1, 4, 300)
    np.fill_diagonal(meet, False)
    nodes = spark.createDataFrame([(i, int(w), bytearray(x.tobytes())) for i, (w, x) in enumerate(zip(weight, sig))], "node bigint, n_texts bigint, sig binary")
    rows = simhash.links_of(nodes, tables, cap, dense, near, near_all).collect()
    got = np.zeros(300, np.int64)
    for r in rows:
        if r.v is None:
            got[r.u] += r.n
    assert np.array_equal(got, (meet & close) @ weight) and got.sum() > 1000
    label = list(range(300))
    for r in rows:
        if r.v is not None:
            assert meet[r.u, r.v] and close[r.u, r.v]
            a, b = label[r.u], label[r.v]
            label = [a if x == b else x for x in label]
    assert all(label[i] == label[j] for i, j in zip(*np.nonzero(meet & close)))


def test_groups_of():
    rng = np.random.default_rng(0)
    for cap in (3, 10, 1000):
        keys = np.sort(rng.integers(0, 9, 80))
        cuts = [0, *np.sort(rng.integers(0, 80, 6)), 80]
        batches = [pa.record_batch([pa.array(keys[a:b], pa.int64()), pa.array(np.arange(a, b))], names=["k", "i"]) for a, b in zip(cuts, cuts[1:])]
        got = list(simhash.groups_of(iter(batches), "k", cap))
        assert np.array_equal(np.concatenate([t["i"].to_numpy() for t, _ in got]), np.arange(80))
        for key, n in zip(*np.unique(keys, return_counts=True)):
            own = [(t, number) for t, number in got if key in t["k"].to_pylist()]
            if n <= cap:
                assert len(own) == 1 and own[0][1] is None
            else:
                first = np.flatnonzero(keys == key)[0]
                assert all(set(t["k"].to_pylist()) == {key} and t["i"][0].as_py() - first == number for t, number in own)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 199)]
    rows = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert rows == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 199: 199, 200: 199}


def test_stage_and_empty_table(spark):
    rows = [(3, "a b c d", "x", "y"), (1, "a b c d", "x", "y"), (1, "a b c d", "x", "y"), (4, None, "x", "y"), (4, None, "x", "y"), (None, "z", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as row_", "3 as sig")
    out = simhash.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "z"), (1, "a b c d"), (4, "")]
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.stage(spark, df.limit(0), "").count() == 0


def test_stage_keeps_other_texts_of_a_repeated_id(spark, monkeypatch):
    rows = [(1, "alpha beta gamma"), (1, "completely different words stand here"), (2, "alpha beta gamma"), (None, "alpha beta gamma"), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [("None", "only here"), ("1", "alpha beta gamma"), ("1", "completely different words stand here")]
    assert sorted((str(r.doc_id), r.text) for r in simhash.stage(spark, df, "").collect()) == sorted(want)
    # The same rows if texts of many rows are joined apart.
    whole = sorted(map(str, simhash.groups(df).collect()))
    monkeypatch.setattr(simhash, "HOT", 2)
    assert sorted(map(str, simhash.groups(df).collect())) == whole and len(whole) == 6


@pytest.mark.parametrize("n", [1, 10**6, 10**7, 10**9, 10**10])
def test_recall_does_not_fall_with_size(n):
    """Random pairs at a given distance meet as often as stated, by the tables made for n signatures."""
    t = simhash.tables_for(n)
    shared = len(t.shared[0])
    assert n / 2**shared <= simhash.MEAN_BUCKET and simhash.chance(shared, len(t.shared), simhash.NEAR) >= simhash.RECALL
    rng = np.random.default_rng(2)
    for d, least in ((simhash.NEAR, 0.87), (24, 0.98)):
        met = 0
        for _ in range(400):
            x = np.zeros(256, np.uint8)
            x[rng.permutation(256)[:d]] = 1
            met += any(not x[t.shared[g]].any() and any(not x[o].any() for o in t.own[g]) for g in range(len(t.shared)))
        assert met >= least * 400
