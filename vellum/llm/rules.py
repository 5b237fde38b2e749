"""Quality rules by the log-likelihood ratio of hashed n-grams.

Words are runs of characters other than space and tab to carriage return.  Whole words, and pairs of
neighbours, are hashed to ``BUCKETS`` buckets.
Two multinomials over the buckets, of the trusted documents and of all documents, give each
bucket a log-likelihood ratio (smoothed by ``ALPHA`` of the raw distribution).  A text's score is the
mean over its n-grams; it is kept if the base rules let it pass and the score is at least ``THRESHOLD``, which lies
between the scores of held-out good and poor documents (trusted documents being others).

Raw counts are made of all documents, trusted ones of all documents labelled as good.  Their ids are
broadcast if their files are small, else joined by a shuffle.  The ratios are one literal of BUCKETS numbers.

Only DataFrame and SQL functions run.  Null texts count as empty; they fail the base rules, as do all
texts of under 50 words.  Rows of null doc_id are never trusted.  Without trusted documents all ratios
are 0, so that the base rules alone decide.  Extra columns are ignored, repeated rows kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import job

BUCKETS, ALPHA, THRESHOLD = 1 << 16, 300_000.0, -0.12
SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def _rest(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def _most(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def hashed(df: DataFrame) -> DataFrame:
    """Adds 64-bit hashes of the ``words`` (h1) and of neighbouring pairs (h2)."""
    df = df.withColumn("h1", F.transform("words", lambda x: F.xxhash64(x)))
    return df.withColumn("h2", F.zip_with(_most(F.col("h1")), _rest(F.col("h1")), lambda a, b: F.xxhash64(a, b)))


def repeated(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of three words that occur at least twice in the text.
    Windows are told apart by 64-bit hashes; equal ones meet by sorting within the row."""
    df = df.withColumn("w3", F.zip_with(_most(F.col("h2")), _rest(_rest(F.col("h1"))), lambda p, c: F.xxhash64(p, c)))
    plain = F.size(F.array_distinct("w3")) == F.size("w3")
    df = df.withColumn("s3", F.when(~plain, F.sort_array(F.transform("w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    none = F.array().cast("array<int>")
    both = F.zip_with(_most(F.col("s3")), _rest(F.col("s3")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
    df = df.withColumn("at3", F.sort_array(F.array_distinct(F.flatten(both))))
    steps = F.zip_with(_most(F.col("at3")), _rest(F.col("at3")), lambda a, b: F.least(b - a, F.lit(3)))
    total = F.aggregate(steps, F.lit(0), lambda acc, x: acc + x) + 3
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("bigint")).drop("w3", "s3", "at3")


def ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> list[float]:
    """The log-likelihood ratio of each bucket.  docs: doc_id, text; trusted: doc_id."""
    ids = job.written(trusted.select("doc_id").distinct(), "rules-trusted")
    # By hash, if not by broadcast: the ids are the small side, and texts needn't be sorted.
    ids = F.broadcast(ids) if job.size_of(ids) <= job.BROADCAST_BYTES else ids.hint("shuffle_hash")
    marked = docs.select("doc_id", "text").join(ids.withColumn("good", F.lit(1)), "doc_id", "left")
    # The outer form: for the inner one Spark infers a filter that evaluates the n-grams a second time.
    flat = hashed(marked.select("good", words(F.col("text")).alias("words"))).select("good", F.explode_outer(F.concat("h1", "h2")).alias("h")).where("h is not null")
    rows = flat.groupBy(F.pmod("h", F.lit(n)).cast("int").alias("g")).agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect()
    raw, good = sum(r["raw"] for r in rows), sum(r["good"] for r in rows)
    out = [0.0] * n
    if good:
        for r in rows:
            share = r["raw"] / raw
            out[r["g"]] = math.log((r["good"] + ALPHA * share) / (good + ALPHA) / share)
    return out


def verdicts(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    df = df.withColumn("words", words(F.col("text")))
    some = F.translate("text", BLANKS, "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("lines", lines)
    df = df.select(
        "doc_id", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(some).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    df = repeated(hashed(df).drop("words"))
    table = F.expr("from_json('[" + ",".join(f"{x:.4f}" for x in ratio) + "]', 'array<double>')")
    n = F.lit(len(ratio)).cast("bigint")

    def total(hashes: str) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, n).cast("int")))

    size = F.size("h1") + F.size("h2")
    df = df.withColumn("score", F.when(size > 0, F.round((total("h1") + total("h2")) / size, 6)).otherwise(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"), "score",
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def op4_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = job.documents(spark, sf_dir)
    ratio = ratios(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return verdicts(docs, ratio)
