"""Markdown files, tuples and settings as tables and options."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.registry import Options, parse_tier

EXCLUDED = r"(?:^|/)(?:\.git|\.vellum/cache|node_modules|vendor)/"
TUPLES = "id string, repo string, file string, question string, expected_answer string"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root) and text of all .md files below root, in any case, without excluded folders."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    rel = F.regexp_replace("path", "^" + re.escape(_uri(spark, root)) + "/?", "")
    out = df.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return out.where(~F.col("path").rlike(EXCLUDED))


def _uri(spark: SparkSession, root: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = spark.read.format("binaryFile").load(sorted(set(paths)))
    return df.select("path", F.decode("content", "UTF-8").alias("text"))


def one(spark: SparkSession, text: str, path: str = "") -> DataFrame:
    return spark.createDataFrame([(path, text)], "path string, text string")


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines and those starting with # are skipped, tuples without id, file or question are an error."""
    raw = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#|$)"))
    t = raw.select(F.from_json("value", TUPLES).alias("t")).select("t.*")
    bad = F.coalesce("id", F.lit("")) == ""
    for c in ("file", "question"):
        bad = bad | (F.coalesce(c, F.lit("")) == "")
    return t.withColumn("id", F.when(bad, F.raise_error(F.lit("a tuple lacks id, file or question"))).otherwise(F.col("id")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest table, or an empty one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "source string, sha256 string, tokens_before bigint, tokens_after bigint")
    return spark.read.parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def options_from(settings: str, **override) -> Options:
    """Options from a small YAML file: tier, and under rules: enabled, disabled and max_lines.  Lists given as
    overrides replace those of the file."""
    found: dict[str, list[str] | str] = {}
    key = ""
    for line in settings.splitlines():
        body = line.split(" #")[0].rstrip()
        m = re.match(r"\s*([\w-]+):\s*(.*)$", body)
        if m:
            key, value = m.group(1), m.group(2).strip()
            if value.startswith("["):
                found[key] = [_bare(x) for x in value.strip("[]").split(",") if x.strip()]
            else:
                found[key] = _bare(value) if value else []
        elif (m := re.match(r"\s*-\s*(.+)$", body)) and isinstance(found.get(key), list):
            found[key].append(_bare(m.group(1)))
    get = lambda k: override.get(k, found.get(k))
    lists = {k: tuple(get(k) or ()) for k in ("enabled", "disabled")}
    return Options(parse_tier(get("tier") or "safe"), max_lines=int(get("max_lines") or 20), **lists)


def _bare(s: str) -> str:
    return s.strip().strip("'\"")
