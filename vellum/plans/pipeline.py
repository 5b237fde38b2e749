"""Compression of a corpus: rules of single documents in Arrow kernels, rules of the corpus as joins.

The active rules are known when the plan is made.  Runs of rules that need one document only are fused
into one kernel pass; the three rules that replace what another document already has work on small
tables of units (hash, place, size): the first place of each hash is a minimum, aggregated before it
is shuffled, so a hash that a third of all units share is one row of the result, never one task's work.

``docs``: path and text.  Null texts stay null and are counted nowhere; null paths are empty ones.  Of
documents with one path each is its own row, and the first place of a hash is the least (path, start).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import units
from vellum.operators.lines import Context, Edit
from vellum.operators.registry import Options, Outcome, Rule, run, run_plugins
from vellum.plans import phrasebook, store

STATE = "id bigint, path string, text string, sha256 string, bytes_before bigint, fires map<string,int>, saved map<string,bigint>, errors map<string,string>"
UNITS = "id bigint, path string, start int, end int, bytes int, key string, shape string, line int"
_STATE_ARROW = pa.schema([
    ("id", pa.int64()), ("path", pa.string()), ("text", pa.string()), ("sha256", pa.string()), ("bytes_before", pa.int64()),
    ("fires", pa.map_(pa.string(), pa.int32())), ("saved", pa.map_(pa.string(), pa.int64())), ("errors", pa.map_(pa.string(), pa.string())),
])
_UNITS_ARROW = pa.schema([
    ("id", pa.int64()), ("path", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bytes", pa.int32()),
    ("key", pa.string()), ("shape", pa.string()), ("line", pa.int32()),
])
CROSS = {
    "strip-cross-file-dupes": units.sections,
    "factor-cross-file-paragraphs": units.paragraphs,
    "dedup-cross-file-code-blocks": units.code_blocks,
}


def _map(df: DataFrame, fn, schema: str, arrow: pa.Schema) -> DataFrame:
    store.arrow_batches(df.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                rows = [out for row in part.to_pylist() for out in fn(row)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        pa.default_memory_pool().release_unused()  # Python workers live on

    return df.mapInArrow(step, schema)


def _slices(batch: pa.RecordBatch, rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and about so many bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = min(to, batch.num_rows)


def _outcome(row: dict) -> Outcome:
    return Outcome(row["text"], dict(row["fires"] or ()), dict(row["saved"] or ()), dict(row["errors"] or ()))


def _row(row: dict, o: Outcome) -> dict:
    return row | {"text": o.text, "fires": list(o.fires.items()), "saved": list(o.saved.items()), "errors": list(o.errors.items())}


def kernel(state: DataFrame, rules: list[Rule], options: Options, glossary: dict | None = None, line: str = "", anchor: str | None = None) -> DataFrame:
    """One pass over the texts that applies these rules in order."""
    names = [r.name for r in rules]

    def fn(row: dict) -> list[dict]:
        from vellum.operators.registry import BY_NAME

        if row["text"] is None:
            return [row]
        first = anchor is not None and row["path"] == anchor
        ctx = Context(options.tier, row["path"], options.max_lines, options.compat, glossary or {}, line if first else "")
        return [_row(row, run(_outcome(row), [BY_NAME[n] for n in names], ctx))]

    return _map(state, fn, STATE, _STATE_ARROW)


def unit_table(state: DataFrame, name: str, compat: bool = False) -> DataFrame:
    def fn(row: dict) -> list[dict]:
        if row["text"] is None:
            return []
        found = units.code_blocks(row["text"], compat) if name.startswith("dedup") else CROSS[name](row["text"])
        return [{"id": row["id"], "path": row["path"], **{k: v for k, v in u._asdict().items() if k != "ok"}} for u in found]

    return _map(state.select("id", "path", "text"), fn, UNITS, _UNITS_ARROW)


def _place():
    return F.struct(F.col("path"), F.col("start"), F.col("line"), F.col("id"))


def first_places(u: DataFrame, key: str) -> DataFrame:
    return u.groupBy(key).agg(F.min(_place()).alias("first"))


def repeated_elsewhere(u: DataFrame, with_line: bool, guard: bool) -> DataFrame:
    """Edits (id, start, end, text) for units whose key, or else whose shape, another document has first.  Shapes
    are compared among units that are the first of their key's document."""

    def reference(first: str):
        name = F.element_at(F.split(F.col(f"{first}.path"), "/"), -1)
        tail = F.concat(F.lit(":"), F.col(f"{first}.line").cast("string")) if with_line else F.lit("")
        lead = "[same as " if with_line else "[same as in "
        return F.concat(F.lit(lead), name, tail, F.lit("]\n"))

    keyed = u.join(first_places(u, "key"), "key")
    exact = keyed.where("path <> first.path").select("id", "start", "end", "bytes", reference("first").alias("text"))
    if guard:
        exact = exact.where(F.octet_length("text") < F.col("bytes"))
    own = keyed.where("path = first.path and shape <> ''").drop("first")
    shaped = own.join(first_places(own, "shape"), "shape").where("path <> first.path")
    shaped = shaped.select("id", "start", "end", "bytes", reference("first").alias("text")).where(F.octet_length("text") < F.col("bytes"))
    return exact.unionByName(shaped).select("id", "start", "end", "text")


def repeated_paragraphs(u: DataFrame, least: int = 3) -> DataFrame:
    """Edits for paragraphs from their third occurrence on, in documents other than the first one's.  The third is
    whatever comes after the second, so two minima serve in place of numbering."""
    first = first_places(u, "key")
    rest = u.join(first, "key").where(_place() > F.col("first"))
    if least > 2:
        second = rest.groupBy("key").agg(F.min(_place()).alias("second"))
        rest = rest.join(second, "key").where(_place() > F.col("second"))
    mark = F.concat(F.lit("[same as in "), F.element_at(F.split("first.path", "/"), -1), F.lit("]"))
    return rest.where("path <> first.path").select("id", "start", "end", "bytes", mark.alias("text")).where(F.octet_length("text") + 1 < F.col("bytes")).select("id", "start", "end", "text")


def splice(state: DataFrame, edits: DataFrame, name: str) -> DataFrame:
    """Applies a corpus rule's edits.  A document's edits are at most as many as its units."""
    grouped = edits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("edits"))
    grouped = store.written(grouped, "edits")
    joined = state.join(store.maybe_broadcast(grouped), "id", "left")

    def fn(row: dict) -> list[dict]:
        edits_ = row.pop("edits")
        if not edits_:
            return [row]
        o = _outcome(row)
        o.take(name, [Edit(e["start"], e["end"], e["text"]) for e in edits_])
        return [_row(row, o)]

    return _map(joined.select(*[f.split(" ")[0] for f in STATE.split(", ")], "edits"), fn, STATE, _STATE_ARROW)


def start(docs: DataFrame) -> DataFrame:
    """The state before any rule.  Rows are numbered once and written, so that numbers stay."""
    empty = "cast(map() as map<string,{}>)"
    df = docs.select(
        F.monotonically_increasing_id().alias("id"), F.coalesce("path", F.lit("")).alias("path"), F.col("text"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("bytes_before"), F.expr(empty.format("int")).alias("fires"),
        F.expr(empty.format("bigint")).alias("saved"), F.expr(empty.format("string")).alias("errors"),
    )
    return df


def compress(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """path, output, sizes and estimated tokens before and after, fires, bytes saved and errors by rule, and the hash of the
    text before."""
    rules = options.rules()
    state = start(docs)
    crossing = [r for r in rules if r.apply is None]
    glossary = None
    pending: list[Rule] = []
    if crossing:
        state = store.written(state, "start")

    def flush(state: DataFrame) -> DataFrame:
        if not pending:
            return state
        kw = {}
        if glossary is not None and any(r.name == "factor-phrase-dictionary" for r in pending):
            names, line, anchor = glossary
            kw = {"glossary": names, "line": line, "anchor": anchor}
        out = kernel(state, list(pending), options, **kw)
        pending.clear()
        return out

    for rule in rules:
        if options.tree_glossary and rule.name == "factor-phrase-dictionary":
            # Written, so that the rules before run once, for the glossary and for what follows.
            state = store.written(flush(state), "state")
            glossary = phrasebook.mine(state, options.compat)
        if rule.apply is not None:
            pending.append(rule)
            continue
        state = store.written(flush(state), "state")
        u = store.written(unit_table(state, rule.name, options.compat), "units")
        if rule.name == "factor-cross-file-paragraphs":
            edits = repeated_paragraphs(u, 2 if options.tree_glossary and options.compat else 3)
        else:
            blocks = rule.name.startswith("dedup")
            edits = repeated_elsewhere(u, with_line=blocks, guard=blocks)
        state = splice(state, edits, rule.name)
    state = flush(state)
    if options.plugins:
        plugins, tier = options.plugins, options.tier

        def fn(row: dict) -> list[dict]:
            return [row] if row["text"] is None else [_row(row, run_plugins(_outcome(row), plugins, tier))]

        state = _map(state, fn, STATE, _STATE_ARROW)
    from vellum.functions.text import token_estimate_of

    after = F.octet_length("text").cast("bigint")
    return state.select(
        "path", F.col("text").alias("output"), "bytes_before", after.alias("bytes_after"),
        token_estimate_of(F.col("bytes_before")).alias("tokens_before"), token_estimate_of(after).alias("tokens_after"), "fires", "saved", "errors", "sha256",
    )
