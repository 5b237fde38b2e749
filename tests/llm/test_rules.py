"""Base counts against a plain loop; the ratio's verdicts against the labels; edges."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from vellum.llm import job, rules

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def base(t):
    t = t or ""
    w = re.findall(WORD, t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_base_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "a", "a a", "a a a", "a a a a", "é x \x0b y\x1cz", "l\n\nl\n \nl", "x " * 50_000]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "é", "😀", " ", " ", "\n", "\t", "\r", "#", "|", "aa "]) for _ in range(rng.randint(0, 90))))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")
    rows = rules.verdicts(df.union(df.limit(1)), [0.0] * 16).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.score == 0 and r.kept == (not r.base_failed)
    assert rules.verdicts(df.limit(0), [0.0] * 16).count() == 0


def test_ratios_against_a_plain_count(spark):
    rows = [(1, "one two one", 0), (2, "three", 0), (3, None, 0), (1, "two", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, good int")
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    n = 1 << 14
    at = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(n))).first()[0] for w in ("one", "two", "three")}
    got = rules.ratios(docs, trusted, n)
    raw, good = 4 + 1 + 2, 4 + 2
    for w, r, g in (("one", 2, 2), ("two", 2, 2), ("three", 1, 0)):
        share = r / raw
        assert math.isclose(got[at[w]], math.log((g + rules.ALPHA * share) / (good + rules.ALPHA) / share))
    assert set(rules.ratios(docs, trusted.limit(0), n)) == {0.0}


def test_verdicts_against_plain_counts(spark):
    """Scores and verdicts of all texts of a small corpus, by loops over whole words and pairs."""
    rng = random.Random(9)
    vocab = ["prefix%dtail" % k for k in range(60)]
    texts = [" ".join(rng.choice(vocab[:40] if k % 3 else vocab[20:]) for _ in range(rng.randint(40, 90))) for k in range(60)] + [None, "", "one"]
    good = {k for k in range(60) if k % 3 and k % 2}
    grams = [(w := re.findall(WORD, t or "")) and [*((x,) for x in w), *zip(w, w[1:])] for t in texts]
    n = 1 << 14
    kinds = sorted({g for gs in grams for g in gs})
    one = spark.createDataFrame([(x[0],) for x in kinds if len(x) == 1], "a string").select("a", F.xxhash64("a").alias("h"))
    two = spark.createDataFrame([x for x in kinds if len(x) == 2], "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h"))
    bucket = {(r.a,): r.h % n for r in one.collect()} | {(r.a, r.b): r.h % n for r in two.collect()}
    raw, own = collections.Counter(bucket[g] for gs in grams for g in gs), collections.Counter(bucket[g] for k in good for g in grams[k])
    total, trusted = sum(raw.values()), sum(own.values())
    ratio = {b: math.log((own[b] + rules.ALPHA * c / total) / (trusted + rules.ALPHA) / (c / total)) for b, c in raw.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rules.ratios(docs, spark.createDataFrame([(k,) for k in good], "doc_id bigint"), n)
    rows = rules.verdicts(docs, got, 0.0).collect()
    for r in rows:
        gs = grams[r.doc_id]
        score = sum(ratio[bucket[g]] for g in gs) / len(gs) if gs else 0.0
        assert math.isclose(r.score, score, abs_tol=2e-4)
        assert abs(score) < 2e-4 or r.kept == (len(re.findall(WORD, texts[r.doc_id] or "")) >= 50 and not r.base_failed and score >= 0)
    assert len({r.kept for r in rows}) == 2


def test_held_out_labels_are_separated(spark):
    """Documents that were not trusted are kept if labelled as good, and not if labelled as poor."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    ratio = rules.ratios(docs, rules.trusted_ids(labels.where(~apart)))
    rows = rules.verdicts(docs, ratio).join(labels.where(apart), "doc_id").where("not base_failed").collect()
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert len(kept[0]) >= 4 and len(kept[1]) > 40
    assert sum(kept[1]) >= 0.95 * len(kept[1]) and sum(kept[0]) <= 0.05 * len(kept[0])


def test_all_good_documents_are_counted(spark, monkeypatch):
    labels = spark.range(25_000).selectExpr("id as doc_id", "cast(id % 25 > 0 as int) as quality")
    trusted = rules.trusted_ids(labels.union(labels.limit(3)))
    assert trusted.count() == 24_000
    docs = spark.range(25_000).selectExpr("id as doc_id", "if(id % 25 > 0, 'good', 'poor') as text")
    docs = docs.union(spark.createDataFrame([(None, "good")], "doc_id bigint, text string"))
    buckets = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(1 << 14))).first()[0] for w in ("good", "poor")}
    for limit in (job.BROADCAST_BYTES, -1):
        monkeypatch.setattr(job, "BROADCAST_BYTES", limit)
        got = rules.ratios(docs, trusted)
        for w, r, g in (("good", 24_001, 24_000), ("poor", 1000, 0)):
            share = r / 25_001
            assert math.isclose(got[buckets[w]], math.log((g + rules.ALPHA * share) / (24_000 + rules.ALPHA) / share))
