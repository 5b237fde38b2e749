"""Latent search against brute force on the words; the subsequence check; paraphrases; edges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import decontam, text

SF = "/root/testdata/sf0.01"


def words(s):
    c = text.words(pa.array([s], pa.string()), text.ALNUM)
    return [c.pieces[k] for k in c.codes]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_by_bits():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert decontam.lcs(a, b) == slow_lcs(a, b)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def brute(rows, items):
    """(doc_id, item_id) for which some stretch of twice the item's words passes verify(), at every eighth of it.  Stretches with
    too few words of the item can't pass and are left out."""
    texts = text.hashed_words(pa.array([t for _, t in rows], pa.string()), text.ALNUM)
    want = set()
    for item_id, item in items:
        w = text.hashed_words(pa.array([item], pa.string()), text.ALNUM).hashes
        need, size = int(np.ceil(decontam.COVER_ANSWER * len(w))), 2 * len(w)
        run = np.concatenate([[0], np.cumsum(np.isin(texts.hashes, w))])
        for (doc_id, _), a, z in zip(rows, texts.ptr.tolist(), texts.ptr[1:].tolist()):
            if run[z] - run[a] < need:
                continue
            s = np.arange(a, max(a + 1, z - size + max(1, len(w) // 8)), max(1, len(w) // 8))
            e = np.minimum(s + size, z)
            some = run[e] - run[s] >= need
            if any(decontam.verify(w.tolist(), texts.hashes[i:j].tolist()) for i, j in zip(s[some], e[some])):
                want.add((doc_id, item_id))
    return want


def test_recall_against_brute_force(spark, tables):
    docs, bench = tables
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng, frames, planted = random.Random(5), [r.text.split() for r in docs.where("length(text) > 300").orderBy("doc_id").limit(60).collect()], []
    for every in (3, 4, 6):  # one word in so many is another, none of the last three
        for k, (_, item) in enumerate(rng.sample(items, 40)):
            w = item.split()
            for at in range(rng.randrange(every), len(w) - 3, every):
                w[at] = "other%d" % rng.randrange(1000)
            frame = rng.choice(frames)
            cut = rng.randrange(len(frame))
            planted.append((90_000 + 100 * every + k, " ".join(frame[:cut] + w + frame[cut:])))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id bigint, text string"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()}
    assert len(want) > 140 and len({d for d, _ in want if d >= 90_000}) == 120
    assert len(got & want) >= 0.97 * len(want)
    by_id, text_of = {r.doc_id: words(r.text) for r in docs.collect()}, {i: words(t) for i, t in items}
    assert all(slow_lcs(text_of[i], by_id[d]) >= decontam.COVER_ANSWER * len(text_of[i]) for d, i in got)


def test_paraphrases_and_edges(spark, tables):
    docs, bench = tables
    rng = random.Random(3)
    item = next(r for r in bench.orderBy("item_id").collect() if len(r.text.split()) > 30)
    w = item.text.split()
    for k in rng.sample(range(3, len(w) - 4), len(w) // 6):
        w[k] = "otherword"
    clean = docs.where("doc_id = 1").first().text.split()
    rows = [
        (70001, " ".join(clean[:40] + w + clean[40:])), (70002, " ".join((clean * 30)[:900] + item.text.split() + clean * 200)),
        (70002, " ".join((clean * 30)[:900] + item.text.split() + clean * 200)), (70003, None), (70004, ""), (None, item.text), (70005, "x" * 100_000),
    ]
    more = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], docs.schema)
    got = [(r.doc_id, r.item_id) for r in decontam.matches(docs.unionByName(more), bench).where("doc_id is null or doc_id > 70000").collect()]
    assert sorted(got, key=str) == sorted([(70001, item.item_id), (70002, item.item_id), (70002, item.item_id), (None, item.item_id)], key=str)
    assert decontam.matches(docs.limit(0), bench).count() == 0
    assert decontam.matches(docs.limit(5), bench.limit(0)).count() == 0


def test_stage_keeps_the_rest(spark, tables):
    docs, bench = tables
    bad = {r.doc_id for r in decontam.matches(docs, bench).collect()}
    out = decontam.stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_long_and_short_items(spark, tables):
    docs, _ = tables
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    frame = docs.where("doc_id = 1").first().text.split()
    items, rows = [], []
    for k, n in enumerate((129, 256, 300, 400, 513, 2000, 1, 2, 3, 5, 7)):
        item = [rng.choice(vocab) for _ in range(n)] if n > 128 else ["short%dword%d" % (k, j) for j in range(n)]
        items.append((k, " ".join(item)))
        rows.append((80000 + k, " ".join(frame * 3 + item + frame * 3)))
        # Half of a long item isn't enough, unless its end is there; a short item must be whole and in a row.
        rows.append((81000 + k, " ".join(frame + item[:n * 6 // 10] + frame)))
        rows.append((82000 + k, " ".join(frame + item[-(n * 6 // 10):] + frame) if n > 128 else " ".join(frame)))
    more = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], docs.schema)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.lcs for r in decontam.matches(docs.limit(300).unionByName(more), bench).collect()}
    assert {(80000 + k, k) for k, _ in items} | {(82000 + k, k) for k in range(6)} == set(got)
    assert all(got[80000 + k, k] > 0.99 for k, _ in items)


def test_blocks_of_items_and_clashing_columns(spark, tables, monkeypatch):
    docs, bench = tables
    docs = docs.selectExpr("*", "1 as item_id", "2 as cosine", "3 as lcs", "4 as first_word").limit(400)
    bench = bench.selectExpr("*", "'x' as doc_id", "0.5 as cosine").limit(60)
    whole = sorted((r.doc_id, r.item_id, r.lcs) for r in decontam.matches(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 25)
    assert whole and sorted((r.doc_id, r.item_id, r.lcs) for r in decontam.matches(docs, bench).collect()) == whole


def test_basis_is_of_all_documents(spark, tables):
    """The basis against the sketch of every passage by plain loops, also of documents that share or lack a doc_id."""
    rng = random.Random(12)
    vocab = ["basis%dword" % k for k in range(400)]
    texts = [" ".join(rng.choice(vocab[k // 20:k // 20 + 200]) for _ in range(rng.randint(1, 70))) for k in range(3000)] + [None, "", "!"]
    docs = spark.createDataFrame([(None if k % 50 == 0 else k % 2900, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    bench = tables[1].limit(20)
    df = decontam.document_frequency(docs)
    idf, g = decontam.idf_of(df), decontam._gaussian()

    def sketch(rows):
        total = np.zeros((decontam.VOCAB, decontam.RANK))
        for t in rows:
            h = (text.hashed_words(pa.array([t], pa.string()), text.ALNUM).hashes % np.uint64(decontam.VOCAB)).astype(int).tolist()
            for at in range(0, len(h), decontam.FIT_PASSAGE):
                a = np.zeros(decontam.VOCAB)
                for b in h[at:at + decontam.FIT_PASSAGE]:
                    a[b] += idf[b]
                some = np.flatnonzero(a)
                a = a[some] / np.linalg.norm(a)
                total[some] += a[:, None] * (a @ g[some])
        return total

    one, own = sketch(texts), sketch([r.text for r in bench.collect()])
    want = np.linalg.qr(one + decontam.OUTWEIGH * np.linalg.norm(one) / np.linalg.norm(own) * own)[0]
    got = decontam.fit(docs, bench, df) / idf[:, None]
    assert np.linalg.svd(want.T @ got, compute_uv=False).min() > 0.999
