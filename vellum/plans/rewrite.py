"""The model tier: long prose paragraphs rewritten by an injected model and accepted by another.

A paragraph is offered if it has at least ``LEAST_TOKENS`` estimated tokens and is plain prose. A rewrite counts if a judge,
which must not be the rewriter, scores it at least ``LEAST_SCORE`` and it is shorter.  Equal paragraphs are rewritten
once, and what the cache has (by model, prompt and paragraph) isn't asked again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.lines import Edit, apply_edits, size, split_lines, trim
from vellum.operators.prose import is_prose
from vellum.plans import store
from vellum.plans.evaluate import score_of

LEAST_TOKENS, LEAST_SCORE = 200, 0.95
REWRITE = "Say this paragraph in fewer words. Keep every fact, name, number and piece of code. Reply with the paragraph only.\n\n{}"
JUDGE = "From 0 to 1, how much of what the first text says does the second keep? Reply as JSON {{\"score\": ...}}.\n\nFirst:\n{}\n\nSecond:\n{}"


@dataclass(frozen=True)
class Models:
    rewrite: Callable[[str], str]
    judge: Callable[[str], str]
    name: str = "model"
    judge_name: str = "judge"

    def __post_init__(self):
        if self.judge is None or self.judge_name == self.name:
            raise ValueError("a judge is needed, and it must not be the model that rewrites")


def offered(src: str) -> list[tuple[int, int]]:
    """Character ranges of the paragraphs that are long enough."""
    lines, out, i = split_lines(src), [], 0
    while i < len(lines):
        if lines[i].fenced or lines[i].text[:4] == "    " or not is_prose(trim(lines[i].text)) or trim(lines[i].text)[:3] in ("```", "~~~"):
            i += 1
            continue
        first = i
        while i < len(lines) and not lines[i].fenced and is_prose(trim(lines[i].text)) and trim(lines[i].text)[:3] not in ("```", "~~~"):
            i += 1
        start, end = lines[first].start, lines[i - 1].start + len(lines[i - 1].text)
        if -(-size(src[start:end]) // 4) >= LEAST_TOKENS:
            out.append((start, end))
    return out


def unfenced(reply: str) -> str:
    """Without a fence around the whole reply."""
    lines = reply.strip().split("\n")
    return "\n".join(lines[1:-1]).strip() if len(lines) > 2 and lines[0].startswith("```") and lines[-1].strip() == "```" else reply.strip()


def key_of(models: Models, paragraph: str) -> str:
    return hashlib.sha256("\0".join((models.name, REWRITE, paragraph)).encode()).hexdigest()


def rewrites(docs: DataFrame, models: Models, cache: DataFrame | None = None) -> DataFrame:
    """(key, original, rewrite, score) of every distinct paragraph that is offered; rewrite is null if it wasn't accepted."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t[s:e] for t in batch.column(0).to_pylist() if t for s, e in offered(t)]
            yield pa.record_batch([pa.array([key_of(models, p) for p in found], pa.string()), pa.array(found, pa.string())], names=["key", "original"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, scores = [], []
            for p in batch.column("original").to_pylist():
                try:
                    r = unfenced(models.rewrite(REWRITE.format(p)))
                    score = score_of(models.judge(JUDGE.format(p, r))) or 0.0
                except Exception:  # a failing backend leaves the paragraph as it is
                    r, score = "", 0.0
                good = bool(r) and score >= LEAST_SCORE and size(r) < size(p)
                new.append(r if good else None)
                scores.append(score)
            yield pa.record_batch([batch.column("key"), batch.column("original"), pa.array(new, pa.string()), pa.array(scores, pa.float64())], names=["key", "original", "rewrite", "score"])

    schema = "key string, original string, rewrite string, score double"
    wanted = docs.select("text").mapInArrow(pick, "key string, original string").dropDuplicates(["key"])
    if cache is None:
        return wanted.mapInArrow(ask, schema)
    known = wanted.join(cache.select("key", "rewrite", "score").dropDuplicates(["key"]), "key").select("key", "original", "rewrite", "score")
    return known.unionByName(wanted.join(cache.select("key"), "key", "left_anti").mapInArrow(ask, schema))


def rewrite(docs: DataFrame, models: Models, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (path, text) rewritten, and the cache to keep."""
    done = store.written(rewrites(docs, models, cache), "rewrites")
    numbered = store.written(docs.select("path", "text").withColumn("id", F.monotonically_increasing_id()), "rewrite-docs")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, e, key_of(models, t[s:e])) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if t for s, e in offered(t)]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["id", "start", "end", "key"])

    places = numbered.select("id", "text").mapInArrow(pick, "id bigint, start int, end int, key string")
    edits = places.join(done.where("rewrite is not null").select("key", "rewrite"), "key")
    edits = edits.groupBy("id").agg(F.collect_list(F.struct("start", "end", "rewrite")).alias("edits"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [
                t if not e else apply_edits(t, [Edit(x["start"], x["end"], x["rewrite"]) for x in e])
                for t, e in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist())
            ]
            yield pa.record_batch([batch.column("path"), pa.array(text, pa.string())], names=["path", "text"])

    return numbered.join(edits, "id", "left").select("path", "text", "edits").mapInArrow(put, "path string, text string"), done
