"""Faithfulness of compressed texts, judged by an injected backend.

A backend is any callable from prompt to answer; tests use a scripted one.  Prompts are made of the
texts in the table, calls run in Arrow batches, and equal (text, question) pairs are asked once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.operators.registry import RULES, Options
from vellum.plans import pipeline, stats, store

Backend = Callable[[str], str]
ANSWER = "Answer from this document only; say NOT FOUND if it isn't there.\n\nDocument:\n{text}\n\nQuestion: {question}\nAnswer:"
JUDGE = (
    "Do both answers say the same? Reply with JSON {{\"verdict\": \"pass|degraded|fail\", \"reason\": \"...\"}}.\n"
    "Question: {question}\nExpected: {expected}\nFirst answer: {original}\nSecond answer: {compressed}\n"
)
QUESTIONS = (
    "Write {n} questions that this document answers, as a JSON array of strings. Choose others than for variants before number {seed}.\n\n"
    "Document:\n{text}\n"
)
SCORE = (
    "How much of what the first answer says does the second one keep, from 0 to 1? Reply with JSON {{\"score\": 0.5, \"reason\": \"...\"}}.\n"
    "Question: {question}\nFirst answer: {original}\nSecond answer: {compressed}\n"
)
QUESTIONS_PER_DOC, SEEDS, THRESHOLD = 10, 1, 0.95


def not_found(answer: str) -> bool:
    return answer.strip().strip(".!\"'").lower().replace("_", " ").startswith("not found")


def json_part(reply: str) -> dict:
    """The first JSON object of a reply that may have more around it."""
    m = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        out = json.loads(m.group()) if m else {}
    except ValueError:
        out = {}
    return out if isinstance(out, dict) else {}


def verdict_of(reply: str) -> str:
    v = str(json_part(reply).get("verdict", "")).lower()
    return v if v in ("pass", "degraded", "fail") else "fail"


def score_of(reply: str) -> float | None:
    """A score from 0 to 1, out of JSON or else the first number."""
    raw = json_part(reply).get("score")
    if raw is None:
        m = re.search(r"(?<![\d.])(?:[01](?:\.\d*)?|\.\d+)(?!\d)", reply)
        raw = m.group() if m else None
    try:
        v = float(raw)
    except (TypeError, ValueError):
        return None
    return v if 0 <= v <= 1 else None


def questions_of(reply: str) -> list[str]:
    """Questions out of a JSON array, or one on each line."""
    m = re.search(r"\[.*\]", reply, re.DOTALL)
    try:
        found = [q.get("text", "") if isinstance(q, dict) else str(q) for q in json.loads(m.group())] if m else []
    except ValueError:
        found = []
    return [q for q in found if q] or [t for x in reply.splitlines() if (t := re.sub(r"^\s*(?:[-*]|\d+[.)])\s*", "", x).strip()).endswith("?")]


def ask(df: DataFrame, prompt: str, out: str, backend: Backend) -> DataFrame:
    """Adds the backend's answers to the prompts in a column."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([backend(p) for p in batch.column(prompt).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def _prompt(template: str, **columns: str) -> F.Column:
    parts, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    for piece in re.split(r"(\{\w+\})", rest):
        name = piece[1:-1] if piece.startswith("{") else ""
        parts.append(F.coalesce(F.col(columns[name]).cast("string"), F.lit("")) if name else F.lit(piece.replace("\0", "{").replace("\1", "}")))
    return F.concat(*parts)


def chosen(tuples: DataFrame, names: str) -> DataFrame:
    """The tuples whose id or repo is among the names, which commas separate; all if there are none."""
    wanted = [n for n in (x.strip() for x in names.split(",")) if n]
    return tuples.where(F.col("id").isin(wanted) | F.col("repo").isin(wanted)) if wanted else tuples


def _before_and_after(docs: DataFrame, options: Options) -> DataFrame:
    """(path, before, after) of each distinct document, written.  Where docs has a repo, it leads the path."""
    if "repo" in docs.columns:
        docs = docs.withColumn("path", F.concat(F.coalesce("repo", F.lit("")), F.lit("/"), F.coalesce("path", F.lit(""))))
    docs = docs.select(F.coalesce("path", F.lit("")).alias("path"), "text").where("text is not null").dropDuplicates(["path", "text"])
    done = pipeline.compress(docs, options).select("path", "sha256", F.col("output").alias("after"))
    texts = docs.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("text").alias("before"))
    return store.written(texts.join(done, ["path", "sha256"]).drop("sha256"), "before-after")


def _answered(rows: DataFrame, backend: Backend) -> DataFrame:
    """Adds the answers ``original`` and ``compressed`` to the question, by before and after; equal (text, question) pairs are asked once."""
    asked = rows.where("before is not null").select("question", F.explode(F.array("before", "after")).alias("text")).distinct()
    asked = asked.withColumn("prompt", _prompt(ANSWER, text="text", question="question"))
    answers = store.written(ask(asked, "prompt", "answer", backend).select("question", "text", "answer"), "answers")
    for side, name in (("before", "original"), ("after", "compressed")):
        rows = rows.join(answers.select("question", F.col("text").alias(side), F.col("answer").alias(name)), ["question", side], "left")
    return rows


def curated(tuples: DataFrame, docs: DataFrame, options: Options, backend: Backend) -> DataFrame:
    """Verdict of each tuple (id, repo, file, question, expected_answer), by file, or by repo and file if docs has a repo.
    Equal texts and equal answers pass without being judged; a tuple whose document is missing gets verdict ``error``."""
    own = F.concat(F.coalesce("repo", F.lit("")), F.lit("/"), F.col("file")) if "repo" in docs.columns else F.col("file")
    rows = store.written(tuples.withColumn("path", own).join(_before_and_after(docs, options), "path", "left").drop("path"), "tuples")
    rows = _answered(rows, backend)
    same = (F.col("before") == F.col("after")) | (F.col("original") == F.col("compressed"))
    rows = store.written(rows.withColumn("same", F.coalesce(same, F.lit(False))), "answered")
    judged = rows.where("not same and before is not null").withColumn("prompt", _prompt(JUDGE, question="question", expected="expected_answer", original="original", compressed="compressed"))
    judged = ask(ask(judged, "prompt", "reply", backend), "reply", "verdict", verdict_of)
    cols = ["id", "repo", "file", "question", "original", "compressed"]
    return (
        judged.select(*cols, "verdict")
        .unionByName(rows.where("same").select(*cols, F.lit("pass").alias("verdict")))
        .unionByName(rows.where("before is null").select(*cols, F.lit("error").alias("verdict")))
    )


def faithfulness(docs: DataFrame, options: Options, backend: Backend, seeds: int = SEEDS, per_doc: int = QUESTIONS_PER_DOC) -> DataFrame:
    """(file, seed, question, original, compressed, score): for each changed document and seed the backend's questions, its answers
    from both texts, and its score of the second answer (0 if it gives none).  An unchanged document is one row with score 1."""
    rows = _before_and_after(docs, options).withColumnRenamed("path", "file")
    asked = rows.where("before <> after").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).withColumn("n", F.lit(per_doc))
    asked = asked.withColumn("prompt", _prompt(QUESTIONS, n="n", seed="seed", text="before"))
    found = ask(ask(asked, "prompt", "reply", backend), "reply", "found", lambda r: json.dumps(questions_of(r)))
    found = found.withColumn("question", F.explode(F.slice(F.from_json("found", "array<string>"), 1, per_doc)))
    found = store.written(found.select("file", "seed", "question", "before", "after"), "questions")
    answered = _answered(found, backend)
    answered = answered.withColumn("prompt", _prompt(SCORE, question="question", original="original", compressed="compressed"))
    scored = ask(ask(answered, "prompt", "reply", backend), "reply", "score", lambda r: str(score_of(r) or 0.0))
    cols = ["file", "seed", "question", "original", "compressed"]
    none = [F.lit(None).cast("int" if c == "seed" else "string").alias(c) for c in cols[1:]]
    same = rows.where("before = after").select("file", *none, F.lit(1.0).alias("score"))
    # A changed document without a question has score 0.
    asked_of = found.select("file").distinct()
    silent = rows.where("before <> after").join(asked_of, "file", "left_anti").select("file", *none, F.lit(0.0).alias("score"))
    return scored.select(*cols, F.col("score").cast("double")).unionByName(same).unionByName(silent)


def file_report(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per file its mean score, its questions, and whether it passes."""
    out = scores.groupBy("file").agg(F.avg("score").alias("score"), F.count("question").alias("n_questions"))
    return out.withColumn("passed", F.col("score") >= threshold)


def sweep(tuples: DataFrame, docs: DataFrame, options: Options, backend: Backend, candidates: list[str] | None = None) -> DataFrame:
    """The curated run repeated without each candidate rule, against the run with all."""
    base = store.written(curated(tuples, docs, options, backend), "baseline")
    runs = None
    for name in candidates or [r.name for r in options.rules()]:
        less = Options(options.tier, tuple(n for n in options.enabled if n != name), (*options.disabled, name), options.max_lines, options.compat)
        one = curated(tuples, docs, less, backend).select(F.lit(name).alias("rule"), "id", "verdict")
        runs = one if runs is None else runs.unionByName(one)
    return stats.ablation(base, runs)


def alone(rule: str, tier: int = 2) -> Options:
    """Options that run this rule only."""
    return Options(tier, (rule,), tuple(r.name for r in RULES if r.name != rule))
