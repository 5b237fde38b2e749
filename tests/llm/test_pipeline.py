"""The pipeline against its stages applied one after another on plain rows."""

import hashlib

import corpus_pipeline
from vellum.llm import bpe, decontam, langcrf, pii, simhash

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "personal data", "tokens"]
    pred = {r.doc_id: r.lang_pred for r in langcrf.predict(docs, langcrf.fit(docs)).collect()}
    rows = [r for r in docs.collect() if pred[r.doc_id] != "und"]
    left = spark.createDataFrame(rows, docs.schema)
    rep = {r.doc_id: r.class_id for r in simhash.groups(left).collect()}
    rows = [r for r in rows if rep[r.doc_id] == r.doc_id]
    left = spark.createDataFrame(rows, docs.schema)
    bad = {r.doc_id for r in decontam.matches(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    left = spark.createDataFrame([r for r in rows if r.doc_id not in bad], docs.schema)
    clean = {r.doc_id: r.text for r in pii.sanitised(left).collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(clean) and 0 < len(out) < docs.count()
    b = bpe.load(bpe.default_path())
    for d, t in clean.items():
        assert out[d].n_tokens == len(b.encode(t)) and out[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_edges(spark, tmp_path):
    """Nulls anywhere, empty and long texts, repeated rows and ids, clashing columns, empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = [r.text for r in docs.where("length(text) > 200").orderBy("doc_id").limit(4).collect()]
    long = " ".join(w for r in docs.collect() for w in (r.text or "").split()) + " write to quux@example.org"
    item = bench.first().text
    new = [(None, some[0]), (9_000_001, None), (9_000_002, ""), (9_000_003, "123 !"), (9_000_004, some[1] + " one"), (9_000_004, some[2] + " two words"),
           (9_000_005, long), (9_000_005, long), (None, "lonely words of nobody in particular"), (9_000_006, some[3] + " " + item)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in new], docs.schema)
    clash = ("1 as row", "'d' as digest", "2 as row_", "3 as terms", "4 as all_", "5 as item_id", "6 as n_tokens", "7 as sig")
    for name, table, items in (("full", docs.unionByName(rows), bench), ("none", docs.limit(0), bench), ("free", docs.limit(50).unionByName(rows), bench.limit(0))):
        table.selectExpr("*", *clash).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    ids = [r.doc_id for r in got]
    assert not {9_000_001, 9_000_002, 9_000_003, 9_000_006} & set(ids)
    assert ids.count(None) >= 1 and ids.count(9_000_005) <= 1
    free = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/free").collect()]
    assert free.count(9_000_005) == 1 and 9_000_001 not in free


def test_decontamination_learns_from_all_rows(spark, monkeypatch):
    """Frequencies and basis are of every row that the stage gets, those without a doc_id too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.union(docs.selectExpr("cast(null as bigint)", "text", "lang", "source", "n_chars"))
    seen, real = [], decontam.job.summed
    monkeypatch.setattr(decontam.job, "summed", lambda df, *a: seen.append(df.count()) or real(df, *a))
    decontam.stage(spark, docs, SF)
    assert seen[:2] == [80, 80]
