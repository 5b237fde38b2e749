"""Accounting: profiles, totals, freshness, savings, verdicts and ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import percent_saved

USD_PER_TOKEN = 3.0 / 1e6


def rule_profile(results: DataFrame) -> DataFrame:
    """Fires, bytes and estimated tokens saved, and errors of every rule, over the results of ``compress``.  A rule that
    fired and saved nothing is flagged."""
    entry = lambda what, x: lambda e: F.struct(e["key"].alias("name"), F.lit(what).alias("what"), x(e["value"]).cast("bigint").alias("x"))
    maps = (("fires", "fires", lambda v: v), ("saved", "bytes_saved", lambda v: v), ("errors", "errors", lambda v: F.lit(1)))
    parts = F.array_compact(F.array(*[F.transform(F.map_entries(c), entry(what, x)) for c, what, x in maps]))
    # One table of all three, as each branch of a union would run the rules again.
    flat = results.select(F.explode(F.flatten(parts)).alias("e")).select("e.*")
    pick = lambda n: F.coalesce(F.sum(F.when(F.col("what") == n, F.col("x"))), F.lit(0)).alias(n)
    out = flat.groupBy("name").agg(pick("fires"), pick("bytes_saved"), pick("errors"))
    out = out.withColumn("tokens_saved", F.floor(F.col("bytes_saved") / 4).cast("bigint"))
    return out.withColumn("flagged", (F.col("fires") > 0) & (F.col("tokens_saved") <= 0))


def totals(manifest: DataFrame) -> DataFrame:
    """One row: files, tokens before, after and saved, percent, and dollars for input tokens."""
    sums = manifest.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_before", "tokens_after")])
    sums = sums.withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after"))
    return sums.withColumn("percent", F.round(percent_saved(F.col("tokens_before"), F.col("tokens_after")), 6)).withColumn(
        "usd", F.round(F.greatest("tokens_saved", F.lit(0)) * F.lit(USD_PER_TOKEN), 6)
    )


def top_savings(manifest: DataFrame, n: int = 10) -> DataFrame:
    saved = manifest.withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after")).where("tokens_saved > 0")
    return saved.select("source", "tokens_saved").orderBy(F.desc("tokens_saved"), "source").limit(n)


def freshness(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each source and each manifest entry with its state: fresh, stale (changed, or without a source any more) or missing
    from the manifest.  docs: path, text; manifest: source, sha256."""
    now = docs.select(F.col("path").alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("now"))
    both = now.join(manifest.select("source", F.col("sha256").alias("then")), "source", "full_outer")
    state = F.when(F.col("then").isNull(), "missing").when(F.col("now") == F.col("then"), "fresh").otherwise("stale")
    return both.select("source", state.alias("state"))


def pending(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents that the manifest doesn't have as they are."""
    keyed = docs.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    return keyed.join(manifest.select(F.col("source").alias("path"), "sha256"), ["path", "sha256"], "left_anti").select(*docs.columns)


def manifest_of(results: DataFrame) -> DataFrame:
    """One row per result of ``compress``: source, hash of its text, tokens, fires, bytes saved and errors."""
    kept = results.select(F.col("path").alias("source"), "sha256", "tokens_before", "tokens_after", "fires", "saved", "errors")
    return kept.withColumn("compressed_at", F.current_timestamp())


def verdict_tallies(verdicts: DataFrame) -> DataFrame:
    """pass, degraded, fail and total for each repo and, under repo null, for all; pass rate 0 where empty."""
    one = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}")
    out = verdicts.rollup("repo").agg(*[one(v) for v in ("pass", "degraded", "fail")], F.count("*").alias("total"), F.grouping("repo").alias("all_repos"))
    return out.withColumn("pass_rate", F.when(F.col("total") > 0, F.round(F.col("n_pass") / F.col("total"), 6)).otherwise(0.0))


def ablation(baseline: DataFrame, runs: DataFrame) -> DataFrame:
    """What each run without one rule changes: (rule, pass_delta, fail_delta, rescued, broke).  baseline: id, verdict; runs:
    rule, id, verdict."""
    both = runs.join(baseline.select("id", F.col("verdict").alias("base")), "id")
    good = lambda c: (F.col(c) == "pass").cast("bigint")
    bad = lambda c: (F.col(c) == "fail").cast("bigint")
    names = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("id"))))
    return both.groupBy("rule").agg(
        F.sum(good("verdict") - good("base")).alias("pass_delta"), F.sum(bad("verdict") - bad("base")).alias("fail_delta"),
        names((F.col("verdict") == "pass") & (F.col("base") != "pass")).alias("rescued"),
        names((F.col("verdict") != "pass") & (F.col("base") == "pass")).alias("broke"),
    )


def mean_of_means(scores: DataFrame) -> DataFrame:
    """Per file the mean of its questions' scores, and the unweighted mean of those."""
    return scores.groupBy("file").agg(F.avg("score").alias("score")).agg(F.avg("score").alias("average"), F.count("*").alias("files"))
