"""Plans over a corpus: set-based cross-document rules against a sequential simulator, glossary, stats, sources, streaming, queries."""

import os
import random

import pyarrow as pa
import pytest

from vellum.operators.registry import AGGRESSIVE, SAFE, Options, Plugin, compress
from vellum.plans import evaluate, phrasebook, pipeline, stats
from vellum.sources import markdown
from vellum.streaming.incremental import compress_stream

SF = "/root/testdata/sf0.001"


def frame(spark, docs):
    return spark.createDataFrame(list(docs), "path string, text string")


def run(spark, docs, options):
    rows = pipeline.compress(frame(spark, docs), options).collect()
    assert all(not r.errors for r in rows)
    return {r.path: r.output for r in rows}


def only(*names):
    o = evaluate.alone(names[0])
    return Options(AGGRESSIVE, tuple(names), tuple(n for n in o.disabled if n not in names))


def simulate(rule, units):
    """The rule told one document after another, in path order, with what it has seen so far."""
    seen, shapes, counts, out = {}, {}, {}, set()
    for u in sorted(units, key=lambda u: (u["path"], u["start"])):
        k = u["key"]
        first = seen.setdefault(k, u)
        counts[k] = counts.get(k, 0) + 1
        name = first["path"].split("/")[-1]
        if rule == "factor-cross-file-paragraphs":
            if counts[k] >= 3 and first["path"] != u["path"] and len(f"[same as in {name}]") + 1 < u["bytes"]:
                out.add((u["path"], u["start"], f"[same as in {name}]"))
            continue
        blocks = rule.startswith("dedup")
        mark = lambda f: f"[same as {f['path'].split('/')[-1]}:{f['line']}]\n" if blocks else f"[same as in {f['path'].split('/')[-1]}]\n"
        if first["path"] != u["path"]:
            if not blocks or len(mark(first)) < u["bytes"]:
                out.add((u["path"], u["start"], mark(first)))
        elif u["shape"]:
            other = shapes.setdefault(u["shape"], u)
            if other["path"] != u["path"] and len(mark(other)) < u["bytes"]:
                out.add((u["path"], u["start"], mark(other)))
    return out


@pytest.mark.parametrize("rule", sorted(pipeline.CROSS))
def test_sets_do_what_a_sequence_does(spark, rule):
    rng = random.Random(len(rule))
    units = []
    for i in range(400):
        k, s = rng.randint(0, 25), rng.randint(0, 6)
        units.append((i, f"d/{rng.randint(0, 9)}.md", i, i + 9, rng.choice([12, 17, 22, 400]), f"k{k}", f"s{s}" if k % 2 else "", i + 1))
    df = spark.createDataFrame(units, pipeline.UNITS)
    ids = {u[0]: u[1] for u in units}
    if rule == "factor-cross-file-paragraphs":
        edits = pipeline.repeated_paragraphs(df)
    else:
        blocks = rule.startswith("dedup")
        edits = pipeline.repeated_elsewhere(df, with_line=blocks, guard=blocks)
    got = {(ids[r.id], r.start, r.text) for r in edits.collect()}
    names = ["id", "path", "start", "end", "bytes", "key", "shape", "line"]
    assert got == simulate(rule, [dict(zip(names, u)) for u in units]) and got


BODY = "This section body holds well over fifteen words so that the rule may look at it at all, as it must.\n"
PARA = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and ten more words to reach over thirty of them\n"


def test_sections(spark):
    out = run(spark, [("a/x.md", "# One\n" + BODY), ("b/y.md", "# Other\n" + BODY), ("b/z.md", "# Own\nshort\n")], only("strip-cross-file-dupes"))
    assert out == {"a/x.md": "# One\n" + BODY, "b/y.md": "# Other\n[same as in x.md]\n", "b/z.md": "# Own\nshort\n"}


def test_paragraphs(spark):
    out = run(spark, [(p, PARA) for p in "abc"], only("factor-cross-file-paragraphs"))
    assert out == {"a": PARA, "b": PARA, "c": "[same as in a]\n"}


def test_code(spark):
    code = "```go\n// c\nfmt.Println(\"hello there\")\nreturn value\n```\n"
    out = run(spark, [("a", "x\n" + code), ("b", code), ("c", "```go\nx()\n```\n")], only("dedup-cross-file-code-blocks"))
    assert out == {"a": "x\n" + code, "b": "```go\n[same as a:2]\n```\n", "c": "```go\nx()\n```\n"}


def test_glossary_over_the_corpus(spark):
    docs = [(f"d{i}", "alpha beta gamma delta epsilon here\n" if i else "no such words\n") for i in range(8)]
    counts = phrasebook.phrase_counts(frame(spark, docs), 5)
    book = phrasebook.glossary(counts).collect()
    assert book[0].name == "T1" and book[0].n == 7
    o = only("factor-phrase-dictionary")
    out = run(spark, docs, Options(o.tier, o.enabled, o.disabled, tree_glossary=True))
    assert out["d0"].startswith("[gloss] T1=") and out["d0"].endswith("no such words\n")
    assert all("T" in out[f"d{i}"] and len(out[f"d{i}"]) < len(docs[i][1]) for i in range(1, 8))


def test_phrases_that_dont_recur_dont_travel(spark):
    """Exact counts, and a table of hashes that has all phrases that occur often enough and few others."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    book = [" ".join(word() for _ in range(7)) for _ in range(30)]
    texts = [None, "", "\n"] + ["\n".join(rng.choice(book) if rng.random() < 0.2 else " ".join(word() for _ in range(12)) for _ in range(20)) for _ in range(60)]
    docs = frame(spark, [(str(i), t) for i, t in enumerate(texts)]).repartition(5)
    want = {r.phrase: r.n for r in phrasebook.phrase_counts(docs).collect()}
    for least in (2, 5):
        often = {p: n for p, n in want.items() if n >= least}
        assert len(often) > 200 and {r.phrase: r.n for r in phrasebook.phrase_counts(docs, least).collect()} == often
        table, bits = phrasebook._frequent(docs, least, False)
        passed = {True: 0, False: 0}
        for t in texts:
            words, found = phrasebook._places([t], False, phrasebook._WordHashes())
            for n, at, g in found:
                for i, place in zip(at.tolist(), (int(x) >> 64 - bits for x in g)):
                    if table[place >> 3] >> (place & 7) & 1:
                        passed[" ".join(words[i:i + n]) in often] += 1
        assert passed[True] == sum(often.values()) and passed[False] < 0.15 * (sum(want.values()) - passed[True])
    assert phrasebook.phrase_counts(docs.limit(0), 5).count() == 0


def test_glossary_takes_one_pass(spark, monkeypatch):
    """The rules before the phrase rule aren't run again to mine the glossary."""
    tables, real = [], pipeline.unit_table
    monkeypatch.setattr(pipeline, "unit_table", lambda state, name, compat: tables.append(name) or real(state, name, compat))
    docs = [(f"d{i}", "alpha beta gamma delta epsilon here\n") for i in range(6)]
    out = run(spark, docs, Options(AGGRESSIVE, tree_glossary=True))
    assert out["d0"].startswith("[gloss] T1=") and sorted(tables) == sorted(pipeline.CROSS)


def test_batches_and_slices_are_bounded_by_bytes(spark):
    texts = ["x" * 700_000, None, "y" * 3_000_000, "", "z" * 600_000] + ["a"] * 1200
    got = list(pipeline._slices(pa.record_batch([pa.array(texts)], names=["text"])))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows <= 500 and (b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= 1 << 20) for b in got) and len(got) == 5
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = spark.range(300).selectExpr("cast(id as string) as path", "repeat('x', 100000) as text").coalesce(1)
    pipeline.kernel(pipeline.start(sizes), [], Options(SAFE))
    seen = sizes.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint").collect()
    assert max(r.n for r in seen) < 6 << 20


def test_pipeline_equals_single_documents(spark):
    docs = [("a.md", "---\nx: y\n---\n# T\n\n\n\nPlease note that it is so.\n"), ("b.md", ""), ("c.md", "Author: x\n| a   | b |\n|---|---|\n| 1 | 2 |\n")]
    for options in (Options(SAFE), Options(AGGRESSIVE), Options(SAFE, plugins=(Plugin("up", str.upper),))):
        assert run(spark, docs, options) == {p: compress(t, options, p).text for p, t in docs}


def test_edges(spark):
    docs = [(None, "x"), ("n", None), ("same", "a\n\n\nb"), ("same", "a\n\n\nb")]
    df = frame(spark, docs).selectExpr("*", "'clash' as output")
    rows = pipeline.compress(df, Options(AGGRESSIVE)).collect()
    assert len(rows) == 4 and sorted(str(r.output) for r in rows) == ["None", "a\n\nb", "a\n\nb", "x"]
    assert pipeline.compress(df.limit(0), Options(AGGRESSIVE)).count() == 0


def test_profile_runs_the_rules_once(spark):
    results = pipeline.compress(frame(spark, [("a", "\n\nx\n\n\n\ny\n")]), Options(SAFE))
    prof = stats.rule_profile(results)
    assert prof._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    maps = spark.sql("select map('r', 2, 's', 1) as fires, map('r', 7L) as saved, cast(null as map<string,string>) as errors union all select null, null, map('s', 'x', 't', null)")
    got = {tuple(r) for r in stats.rule_profile(maps).select("name", "fires", "bytes_saved", "errors", "tokens_saved", "flagged").collect()}
    assert got == {("r", 2, 7, 0, 1, False), ("s", 1, 0, 1, 0, True), ("t", 0, 0, 1, 0, False)}


def test_profile_manifest_and_freshness(spark):
    docs = frame(spark, [("a", "\n\nx\n\n\n\ny\n"), ("b", "Author: me\n"), ("c", "plain\n")])
    results = pipeline.compress(docs, Options(SAFE))
    prof = {r.name: r for r in stats.rule_profile(results).collect()}
    assert prof["strip-metadata-lines"].fires == 1 and prof["strip-metadata-lines"].bytes_saved == 11 and not prof["strip-metadata-lines"].flagged
    m = stats.manifest_of(results)
    t = stats.totals(m).first()
    assert t.files == 3 and t.tokens_saved == t.tokens_before - t.tokens_after > 0
    changed = frame(spark, [("a", "\n\nx\n\n\n\ny\n"), ("b", "new\n"), ("d", "d\n")])
    assert {r.source: r.state for r in stats.freshness(changed, m).collect()} == {"a": "fresh", "b": "stale", "c": "stale", "d": "missing"}
    assert {r.path for r in stats.pending(changed, m).collect()} == {"b", "d"}
    assert stats.top_savings(m).first().source == "b"


def test_evaluation(spark):
    docs = frame(spark, [("f", "Please note that the port is 80.\nAuthor: x\n"), ("g", "same\n")])
    rows = [("1", "r", "f", "Port?", "80"), ("2", "r", "g", "What?", "same"), ("3", "q", "gone", "What?", "x"), ("4", "q", "f", "Author?", "x")]
    tuples = spark.createDataFrame(rows, markdown.TUPLES)

    def backend(prompt):
        if "Do both answers" in prompt:
            return '{"verdict": "fail"}' if "Second answer: NOT FOUND" in prompt else '{"verdict": "pass"}'
        if "Question: Author?" in prompt:
            return "x" if "Author: x" in prompt else "NOT FOUND"
        return "80"

    got = {r.id: r.verdict for r in evaluate.curated(tuples, docs, Options(AGGRESSIVE), backend).collect()}
    assert got == {"1": "pass", "2": "pass", "3": "error", "4": "fail"}
    sweep = evaluate.sweep(tuples, docs, Options(AGGRESSIVE), backend, ["strip-metadata-lines", "strip-toc"]).collect()
    assert {r.rule: (r.pass_delta, list(r.rescued)) for r in sweep} == {"strip-metadata-lines": (1, ["4"]), "strip-toc": (0, [])}
    tally = {r.repo: (r.n_pass, r.total) for r in stats.verdict_tallies(evaluate.curated(tuples, docs, Options(AGGRESSIVE), backend)).collect()}
    assert tally == {"r": (2, 2), "q": (0, 2), None: (2, 4)}


def test_evaluation_by_repo_and_choice(spark):
    docs = spark.createDataFrame([("r", "f", "The port is 80.\nAuthor: x\n"), ("q", "f", "The port is 81.\n")], "repo string, path string, text string")
    rows = [("1", "r", "f", "Port?", "80"), ("2", "q", "f", "Port?", "81"), ("3", "s", "f", "Port?", "82")]
    tuples = spark.createDataFrame(rows, markdown.TUPLES)

    def backend(prompt):
        return '{"verdict": "pass"}' if "Do both answers" in prompt else prompt.split("port is ")[1][:2]

    got = {r.id: (r.original, r.verdict) for r in evaluate.curated(tuples, docs, Options(AGGRESSIVE), backend).collect()}
    assert got == {"1": ("80", "pass"), "2": ("81", "pass"), "3": (None, "error")}
    for names, ids in (("q, 1", ["1", "2"]), (" , ", ["1", "2", "3"]), ("none", [])):
        assert sorted(r.id for r in evaluate.chosen(tuples, names).collect()) == ids


def test_faithfulness(spark):
    docs = frame(spark, [("a", "The port is 80.\nAuthor: x\n"), ("b", "same\n"), ("c", "Author: y\n"), ("n", None)])

    def backend(prompt):
        if prompt.startswith("Write 2"):
            return "nothing" if "Author: y" in prompt else '["Port?", "Author of %s?", "Third?"]' % prompt.split("number ")[1][0]
        if prompt.startswith("How much"):
            return "no number" if "Second answer: NOT FOUND" in prompt else 'Sure: {"score": 1.0}'
        if "Question: Port?" in prompt:
            return "80"
        return "x" if "Author: x" in prompt else "NOT FOUND"

    scores = evaluate.faithfulness(docs, Options(AGGRESSIVE), backend, seeds=2, per_doc=2)
    rows = {(r.file, r.seed, r.question): r.score for r in scores.collect()}
    assert rows == {("a", 1, "Port?"): 1, ("a", 2, "Port?"): 1, ("a", 1, "Author of 1?"): 0, ("a", 2, "Author of 2?"): 0, ("b", None, None): 1, ("c", None, None): 0}
    report = {r.file: (r.score, r.n_questions, r.passed) for r in evaluate.file_report(scores).collect()}
    assert report == {"a": (0.5, 4, False), "b": (1.0, 0, True), "c": (0.0, 0, False)}
    assert stats.mean_of_means(scores).first().average == 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "sub").mkdir()
    for name, body in (("a.md", "# é\n"), ("sub/b.MD", "b"), ("node_modules/c.md", "no"), ("d.txt", "no")):
        (tmp_path / name).write_text(body)
    assert {r.path: r.text for r in markdown.read_tree(spark, str(tmp_path)).collect()} == {"a.md": "# é\n", "sub/b.MD": "b"}
    (tmp_path / "t.jsonl").write_text('# note\n\n{"id": "1", "file": "f", "question": "q?"}\n')
    assert [r.id for r in markdown.read_tuples(spark, str(tmp_path / "t.jsonl")).collect()] == ["1"]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="lacks"):
        markdown.read_tuples(spark, str(tmp_path / "bad.jsonl")).collect()
    o = markdown.options_from("tier: aggressive # x\nrules:\n  disabled:\n    - strip-toc\n  enabled: [dedup-cross-section]\n  max_lines: 7\n", disabled=["strip-badges"])
    assert (o.tier, o.enabled, o.disabled, o.max_lines) == (AGGRESSIVE, ("dedup-cross-section",), ("strip-badges",), 7)
    assert markdown.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_stream(spark, tmp_path):
    src, out, man, chk = (str(tmp_path / x) for x in ("in", "out", "man", "chk"))
    frame(spark, [("a", "x\n\n\n\ny\n"), ("b", "b\n")]).write.parquet(src)
    compress_stream(spark, src, out, man, chk).awaitTermination()
    frame(spark, [("a", "x\n\n\n\ny\n"), ("c", "Author: c\n")]).write.mode("append").parquet(src)
    compress_stream(spark, src, out, man, chk).awaitTermination()
    rows = [(r.path, r.output) for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == [("a", "x\n\ny\n"), ("b", "b\n"), ("c", "")]
    # The last batch is repeated as if it hadn't been committed: nothing is lost, nothing comes twice.
    commits = [p for p in os.listdir(f"{chk}/commits") if "1" in p]
    assert commits
    for p in commits:
        os.remove(f"{chk}/commits/{p}")
    compress_stream(spark, src, out, man, chk).awaitTermination()
    assert sorted((r.path, r.output) for r in spark.read.parquet(out).collect()) == sorted(rows)
    assert spark.read.parquet(man).count() == 3


def test_queries_against_sql(spark):
    import glob

    import duckdb

    from vellum import queries

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name in ("url_tracking", "text_stats", "fence_state", "headings", "dup_paragraphs", "dup_code", "dup_sections", "phrase_glossary", "savings_totals",
                 "freshness", "verdict_tally", "ablation_delta", "rule_strip_setext_headers", "rule_collapse_blank_lines", "rule_strip_seo_chaff", "rule_normalize_unicode"):
        a, b = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns) and len(a) == len(b), name
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert a.equals(b), name


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
