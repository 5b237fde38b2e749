"""The language field: exact marginals against enumeration, held-out accuracy, code-switching."""

import itertools
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellum.llm import langcrf, text

SF = "/root/testdata/sf0.001"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    t_max, labels = 4, 3
    e = rng.normal(size=(t_max, 2, labels))
    trans = rng.normal(size=(labels, labels))
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    e[~mask] = 0
    got, expected = langcrf.marginals(e, trans, mask)
    want_expected = np.zeros((labels, labels))
    for n, length in enumerate((4, 3)):
        total, unary, pairs = 0.0, np.zeros((length, labels)), np.zeros((labels, labels))
        for path in itertools.product(range(labels), repeat=length):
            p = np.exp(sum(e[t, n, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, k in enumerate(path):
                unary[t, k] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(got[:length, n], unary / total)
        want_expected += pairs / total
    assert np.allclose(expected, want_expected)


def test_whole_chains_against_one_loop():
    """Chains of 1 to 12,000 words side by side, each against a plain forward-backward in double precision."""
    rng = np.random.default_rng(4)
    size = np.array([1, 12_000, 0, 7, 300, 300, 2, 0])
    weight, codes, trans = np.exp(rng.normal(size=(50, 3)) * 2), rng.integers(0, 50, size.sum()), rng.normal(size=(3, 3)) + 3 * np.eye(3)
    ptr = np.concatenate([[0], np.cumsum(size)])
    got = langcrf.chain_marginals(weight.astype(np.float32), codes, ptr, trans.astype(np.float32))
    for a, z in zip(ptr, ptr[1:]):
        w, fwd, back = weight[codes[a:z]], [], [np.ones(3)]
        for k in range(z - a):
            x = w[k] if k == 0 else (fwd[-1] @ np.exp(trans)) * w[k]
            fwd.append(x / x.sum())
        for k in range(z - a - 1, 0, -1):
            y = np.exp(trans) @ (back[-1] * w[k])
            back.append(y / y.sum())
        if z > a:
            want = np.array(fwd) * np.array(back[::-1])
            assert np.abs(got[a:z] - want / want.sum(1, keepdims=True)).max() < 1e-4


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langcrf, "TRAIN_DOCS", 60)
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i % 20)} and more", "lang%02d" % (i % 40)) for i in range(800)] + [(801, "x" * 200_000, "toolong")]
    model = langcrf.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["lang%02d" % k for k in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langcrf.fit(docs)


def test_held_out_accuracy(spark, docs, model):
    rows = langcrf.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (text.crc_of_id(r.doc_id) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switching_is_found_by_word(spark, docs, model):
    pick = {r.lang: r.text.replace("\n", " ").split()[:60] for r in docs.where("length(text) > 900").collect()}
    a, b = sorted(pick)[:2]
    df = spark.createDataFrame([(1, " ".join(pick[a] + pick[b]))], "doc_id bigint, text string")
    runs = langcrf.runs(df, model).first().runs
    assert 2 <= len(runs) <= 8 and runs[0].lang == a and runs[-1].lang == b


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of"), (4, "the and of"), (None, "“”"), (6, "x" * 100_000), (7, "the of and " * 40_000)]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in rows], "doc_id bigint, text string, lang string, score string")
    out = langcrf.predict(df, model).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id): r for r in out}
    for i in (1, 2, 3, None):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert got[4].lang_pred in model.langs and got[7].lang_pred == "en" and got[7].n_words == 120_000
    assert langcrf.predict(df.limit(0), model).count() == 0
    # Nothing to learn from: no language is known.
    assert langcrf.fit(df) is None
    assert {r.lang_pred for r in langcrf.predict(df, None).collect()} == {"und"}


def test_stage_drops_only_texts_without_language(spark, docs):
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "...", "en", "s", 3)], docs.schema)
    out = langcrf.stage(spark, docs.union(extra), "")
    assert out.columns == docs.columns and out.count() == docs.count()


def test_every_language_is_learned(spark):
    """More languages than 64, of one document each."""
    ids = [i for i in range(200) if text.crc_of_id(i) % 5][:80]
    rows = [(i, "".join(chr(97 + k // 26 ** j % 26) for j in range(3)) * 2 + " word", "lang%02d" % k) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langcrf.fit(df, 1).langs == sorted(r[2] for r in rows)


def test_stage_memory(docs, model):
    """What the stage holds besides a batch of 24 MB, beyond the model, stays under 46 MB (54 with slices of 6 MB); all rows come back, and as slices of any size give them."""
    import tracemalloc

    rows = docs.toArrow().combine_chunks().to_batches()[0]
    batch = pa.Table.from_batches([rows] * (24_000_000 // rows.nbytes + 1)).combine_chunks().to_batches()[0]
    tracemalloc.start()
    out, langs = 0, []
    for part in langcrf.relabelled(model, iter([batch])):
        out += part.num_rows
        langs += part.column("lang").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == batch.num_rows and peak < 46_000_000
    want = langs[:rows.num_rows]
    assert langs == want * (batch.num_rows // rows.num_rows)


def test_stage_learns_from_all_rows(spark, monkeypatch):
    """Languages that only rows without doc_id, held-out ids, long texts or documents beyond any sample have, by the driver and by jobs."""
    held = [i for i in range(2000) if text.crc_of_id(i) % 5 == 0][:30]
    free = [i for i in range(2000) if text.crc_of_id(i) % 5][:400]
    rng = np.random.default_rng(2)

    def some(letters, n):
        return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))

    rows = [(i, some("abc", 20), "aa") for i in free] + [(None, some("def", 20), "bb") for _ in range(30)] + [(5, some("ghi", 25_000), "cc")] + [(i, some("jkl", 20), "dd") for i in held]
    rows += [(None, None, "ee"), (7, "12", "ff"), (8, some("abc", 9), None)]
    df = spark.createDataFrame([(i, t, x, x) for i, t, x in rows], "doc_id bigint, text string, lang string, source string")
    models = []
    for limit in (langcrf.job.BROADCAST_BYTES, -1):
        monkeypatch.setattr(langcrf.job, "BROADCAST_BYTES", limit)
        out = langcrf.stage(spark, df, "").collect()
        assert len(out) == len(rows) - 2 and {(r.source, r.lang) for r in out} == {*((x, x) for x in ("aa", "bb", "cc", "dd")), (None, "aa")}
        models.append(langcrf.fit_all(df))
    assert np.allclose(models[0].weight, models[1].weight) and np.allclose(models[0].trans, models[1].trans)
    assert langcrf.fit_all(df.where("text is null or lang is null")) is None and langcrf.fit_all(df.where("lang = 'ff'")) is None


def test_chunks_memory_is_bounded(spark, monkeypatch, tmp_path):
    """What a task holds doesn't grow with the input: row groups end by size after any row, and tasks get more with the files' bytes."""
    paths, real = [], langcrf.job.new_path
    monkeypatch.setattr(langcrf.job, "new_path", lambda *a: paths.append(real(*a)) or paths[-1])
    monkeypatch.setattr(langcrf.job, "remove", lambda *a: None)
    monkeypatch.setattr(langcrf, "ROUNDS", 1)
    monkeypatch.setitem(langcrf.WRITTEN, "parquet.block.size", 1 << 16)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    df = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 4000), k -> concat('w', translate(cast(xxhash64(id, k) % 999 as string), '-0123456789', 'xabcdefghij')))) as text", "'xx' as lang")
    langcrf.fit_all(df)
    spark.conf.set(key, before)
    for path in paths:
        files = [pq.ParquetFile(f) for f in Path(path.removeprefix("file://")).glob("*.parquet")]
        assert sum(f.metadata.num_rows for f in files) == 400
        assert max(f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) < 20
    df.write.parquet(at := str(tmp_path / "docs"))
    docs = spark.read.parquet(at)
    few = langcrf.chunks(docs, ["xx"]).rdd.getNumPartitions()
    monkeypatch.setattr(langcrf, "TASK_BYTES", langcrf.job.size_of(docs) // (3 * few))
    assert langcrf.chunks(docs, ["xx"]).rdd.getNumPartitions() >= 3 * few


def test_lexicon_counts_all_words(spark, docs):
    count = {}
    for r in docs.collect():
        c = text.words(pa.array([r.text or ""], pa.large_string()))
        for k in c.codes:
            own = count.setdefault(c.pieces[k], {})
            own[r.lang] = own.get(r.lang, 0) + 1
    langs = sorted({r.lang for r in docs.select("lang").collect()})
    want = {}
    for word, own in count.items():
        top = max(own, key=own.get)
        if sum(own.values()) >= langcrf.LEX_COUNT and own[top] >= langcrf.LEX_SHARE * sum(own.values()):
            want[word] = langs.index(top)
    coded = langcrf.chunks(docs, langs)
    assert coded.agg(F.sum("n")).first()[0] == sum(n for own in count.values() for n in own.values())
    got = langcrf.lexicon(coded, len(langs))
    assert len(got.hashes) == len(want) > 1000
    assert got.of(text.hash_pieces(list(want))).tolist() == list(want.values())
    assert (got.of(text.hash_pieces([w for w in count if w not in want] + [b"nowhere"])) == -1).all()


@pytest.mark.parametrize("total", [1, 63, 64, 65, 500])
def test_expected_counts_of_chunks(total):
    """Against marginals(), which enumeration checks."""
    rng = np.random.default_rng(total)
    e, codes, trans = rng.normal(size=(9, 3)), rng.integers(0, 9, total), rng.normal(size=(3, 3))
    grid = np.full(-(-total // langcrf.CHAIN) * langcrf.CHAIN, -1)
    grid[:total] = codes
    grid = grid.reshape(-1, langcrf.CHAIN).T
    mask = grid >= 0
    m, want_pairs = langcrf.marginals(np.where(mask[..., None], e[grid], 0), trans, mask)
    want = np.zeros((9, 3))
    np.add.at(want, grid[mask], m[mask])
    got, pairs = langcrf.expected_counts(np.exp(e), codes, trans)
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
