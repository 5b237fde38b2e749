"""Queries over the test tables, and the same in DuckDB SQL.

The tables hold no Markdown, so most queries run on ``md_docs``: every document decorated, by its id, with the
shapes that the rules are about.  Its SQL is the same text for both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.registry import BY_NAME, RULES, SAFE, AGGRESSIVE, Options
from vellum.plans import phrasebook, pipeline, stats, store
from vellum.plans.evaluate import alone

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NL = "chr(10)"


def _block(*lines: str) -> str:
    """SQL of lines, each with its newline."""
    return ", ".join(f"{x}, {_NL}" for x in (v if v.startswith("sql:") else "'" + v.replace("'", "''") + "'" for v in lines)).replace("sql:", "")


def _if(cond: str, *lines: str) -> str:
    return f"case when {cond} then concat({_block(*lines)}) else '' end"


_FENCE = "sql:repeat(chr(96), 3)"
_GO = "sql:concat(repeat(chr(96), 3), 'go')"
_PY = "sql:concat(repeat(chr(96), 3), 'python')"
MD_PATH = "concat('docs/', source, '/', lpad(cast(doc_id as string), 8, '0'), '.md')"
MD_TEXT = f"""concat(
    {_if("doc_id % 7 = 0", "---", "title: page", "tags: none", "---")},
    {_if("doc_id % 3 = 0", "sql:concat('# Guide ', cast(doc_id % 5 as string))", "", "Author: someone", "Support for X: yes", "Status: draft under license", "")},
    {_if("doc_id % 3 = 1", "Title of it", "===========", "", "Second title", "---", "")},
    {_if("doc_id % 4 = 0", "[![build](https://img.shields.io/a.svg)](https://ci.example.com)", "![logo](logo.png)", "")},
    {_if("doc_id % 5 = 0", "## Contents", "", "- [One](#one)", "- [Two](#two)", "")},
    {_if("doc_id % 6 = 1", "***", "", "On this page", "Next: the other page", "Home > Docs > Here", "")},
    replace(text, {_NL}, concat({_NL}, {_NL})), {_NL}, {_NL},
    {_if("doc_id % 4 = 1", "Please note that this is “quoted” – and in order to win… see the [guide](https://a.example.com/x?utm_source=feed&id=3) section.", "")},
    {_if("doc_id % 4 = 2", "**NOTE:** mind the gap", "> **Warning** it is hot", "You should see a list", "The output is:", "Edit this page", "- **Default**: none", "--8<-- part.md", "{! inc !}", "")},
    {_if("doc_id % 8 = 3", _GO, 'import "fmt"', "// says hello to the reader", 'fmt.Println("hello world", 1)', "return value", _FENCE, "", "", "", _PY, "# says hello", 'print("hello world", 1)', "return value", _FENCE, "")},
    {_if("doc_id % 8 = 5", _GO, 'fmt.Println("hello world", 1)', "Status: inside", "", "", _FENCE, "")},
    {_if("doc_id % 12 = 8", "<div>", "", "</div>", "", "tool --help", "", _FENCE, "usage: tool", "  --all   everything", _FENCE, "", _FENCE, "sql:concat(repeat(concat('a line of code', chr(10)), 24), 'the last line')", _FENCE, "")},
    {_if("doc_id % 9 = 2", "| Name | Count |", "|------|-------|", "| alpha   | 12   |", "| beta | 7 |", "", "Here alpha has 12 and beta has 7.", "")},
    {_if("doc_id % 9 = 4", "## Shared", "", "This shared section says the same thing in every file that has it, so that a reader of the corpus needs it only once and no more.", "", "### Deeper", "", "Some words below the deeper heading.", "")},
    {_if("doc_id % 10 = 6", "# Changelog", "", "## 1.2.3 - 2025-01-15", "October 20, 2025", "- fix the thing ([#12](https://github.com/a/b/pull/12)) (@user)", "")},
    {_if("doc_id % 11 = 7", "## License", "", "MIT", "", "<!-- end", "of it -->", "")}
)"""
MD_DOCS = f"select {MD_PATH} as path, {MD_TEXT} as text from documents"


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.selectExpr(f"{MD_PATH} as path", f"{MD_TEXT} as text")


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


## scalar functions

_TRACK = r"'[?&](utm_[a-z_]+|fbclid|gclid|[gw]braid|yclid|msclkid|mc_[ce]id|igshid|_g[al]|ref_src|ref|si)=[^&#\t\n\f\r )>\]]*'"
_CLEAN = f"""case when g = url then url else regexp_replace(concat(regexp_extract(g, '^[^?&]*'), regexp_replace(regexp_replace(replace(
    regexp_replace(regexp_replace(g, '^[^?&]*', ''), '^(\\?&*|&)', chr(1)), '?', ''), '&+', '&', 'g'), chr(1), '?')), '[?&]+$', '') end"""


@query("url_tracking", f"with t as (select page_id, url, regexp_replace(url, {_TRACK}, '', 'g') as g from pages), c as (select page_id, url, {_CLEAN} as clean_url from t) "
       "select page_id, clean_url, (strlen(url) - strlen(clean_url))::bigint as bytes_saved from c")
def url_tracking(spark, sf):
    df = _table(spark, sf, "pages").select("page_id", "url", T.clean_url(F.col("url")).alias("clean_url"))
    return df.select("page_id", "clean_url", (F.octet_length("url") - F.octet_length("clean_url")).cast("bigint").alias("bytes_saved"))


@query("html_comments_inline", "with t as (select page_id, html, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as h from pages) select page_id, md5(h) as html_md5, (strlen(html) - strlen(h))::bigint as bytes_saved from t")
def html_comments_inline(spark, sf):
    df = _table(spark, sf, "pages").select("page_id", "html", T.comments_removed(F.col("html")).alias("h"))
    return df.select("page_id", F.md5("h").alias("html_md5"), (F.octet_length("html") - F.octet_length("h")).cast("bigint").alias("bytes_saved"))


_LINES = "case when ends_with(text, chr(10)) or text = '' then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end"


@query("text_stats", rf"""select doc_id, ceil(strlen(text) / 4.0)::bigint as tokens, len(list_filter(regexp_split_to_array(text, '[^\pL\p{{Nd}}]+'), lambda x: x <> ''))::bigint as n_words,
    len({_LINES})::bigint as n_lines, case when regexp_matches(text, '[.!?]') then length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) when trim(text) <> '' then 1 else 0 end::bigint as n_sentences,
    substr(sha256(text), 1, 32) as hash from documents""")
def text_stats(spark, sf):
    t = F.col("text")
    return store.spread(_table(spark, sf, "documents")).select(
        "doc_id", T.token_estimate(t).alias("tokens"), T.word_count(t).alias("n_words"), F.size(T.lines(t)).cast("bigint").alias("n_lines"),
        T.sentence_count(t).alias("n_sentences"), T.short_hash(t).alias("hash"),
    )


#: Numbered lines of md_docs with the fence state before each; the documents use one fence character only.
_L = rf"""md as ({MD_DOCS}),
raw as (select path, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as no from md),
l as (select *, coalesce(sum(case when regexp_matches(line, '^[ \t]*`{{3}}') then 1 else 0 end) over (partition by path order by no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as fenced,
    trim(line, ' ' || chr(9) || chr(13)) as t from raw)"""


@query("fence_state", f"with {_L} select path, count(*)::bigint as n_lines, count(*) filter (fenced)::bigint as n_fenced from l group by path")
def fence_state(spark, sf):
    df = md_docs(spark, sf).select("path", T.lines(F.col("text")).alias("lines"))
    df = df.select("path", "lines", T.fenced(F.col("lines")).alias("fenced"))
    return df.select("path", F.size("lines").cast("bigint").alias("n_lines"), F.size(F.filter("fenced", lambda x: x)).cast("bigint").alias("n_fenced"))


@query("headings", rf"with {_L} select path, no::bigint as line_no, length(regexp_extract(t, '^(#{{1,6}}) ', 1))::bigint as level, trim(regexp_extract(t, '^#{{1,6}} (.*)$', 1)) as heading from l where not fenced and regexp_matches(t, '^#{{1,6}} ')")
def headings(spark, sf):
    df = md_docs(spark, sf).select("path", T.lines(F.col("text")).alias("lines"))
    df = df.select("path", F.explode(F.arrays_zip("lines", T.fenced(F.col("lines")).alias("fenced"), F.sequence(F.lit(1), F.size("lines")).alias("no"))).alias("x"))
    t = F.trim(F.col("x.lines"))
    return df.where(~F.col("x.fenced") & t.rlike("^#{1,6} ")).select(
        "path", F.col("x.no").cast("bigint").alias("line_no"), F.length(F.regexp_extract(t, "^(#{1,6}) ", 1)).cast("bigint").alias("level"),
        F.trim(F.regexp_extract(t, "^#{1,6} (.*)$", 1)).alias("heading"),
    )


## one rule at a time


def _rule_query(rule: str):
    def fn(spark, sf):
        out = pipeline.compress(md_docs(spark, sf), alone(rule))
        return out.select("path", F.md5("output").alias("output_md5"), "bytes_after", F.coalesce(F.element_at("saved", rule), F.lit(0)).alias("bytes_saved"))

    return fn


def _rebuilt(ctes: str, value: str = "line", keep: str = "true", order: str = "no") -> str:
    """SQL that joins the kept lines of ``l`` again."""
    return (
        f"with {_L}{ctes}, o as (select path, coalesce(string_agg(v || chr(10), '' order by {order}), '') as output from (select path, no, {value} as v from x where {keep}) group by path), "
        "a as (select md.path, coalesce(o.output, '') as output, md.text from md left join o using (path)) "
        "select path, md5(output) as output_md5, strlen(output)::bigint as bytes_after, (strlen(text) - strlen(output))::bigint as bytes_saved from a"
    )


def _dropped(cond: str, ctes: str = ", x as (select * from l)") -> str:
    return _rebuilt(ctes, keep=f"not (not fenced and t <> '' and ({cond}))")


def _q(pattern: str) -> str:
    """A Python-side pattern as an RE2 literal."""
    return "'" + pattern.replace("~s", r"[\t\n\f\r ]").replace("~S", r"\t\n\f\r ").replace("'", "''") + "'"


def _i(pattern: str) -> str:
    return f"regexp_matches(t, {_q('^(?i:' + pattern + ')')})"


from vellum.operators import prose  # noqa: E402

_NEIGHBOURS = ", x as (select *, lag(t) over (partition by path order by no) as before, lead(t) over (partition by path order by no) as after, lead(fenced) over (partition by path order by no) as after_fenced, lag(fenced) over (partition by path order by no) as before_fenced, max(no) over (partition by path) as last from l)"
_WORDS = r"len(list_filter(regexp_split_to_array(t, '[^\pL\p{Nd}]+'), lambda w: w <> ''))"
_NOT = lambda signs: f"substr(t, 1, 1) not in ({', '.join(repr(c) for c in signs)})"
RULE_ORACLES = {
    "strip-metadata-lines": _dropped(f"{_NOT('|>#')} and contains(t, ':') and not regexp_matches(lower(t), 'copyright|license|spdx|all rights reserved') and {_i(prose.META)}"),
    "strip-horizontal-rules": _dropped(
        f"regexp_matches(t, {_q('^' + prose.RULE_LINE)}) and not (no = 1 and after = '') and not (no > 1 and before <> '' and trim(before, '-= ') = '')", _NEIGHBOURS),
    "strip-mkdocs-includes": _dropped("starts_with(t, '--8<--') or starts_with(t, ';--8<--') or starts_with(t, '--snippet--') or starts_with(t, '{!')"),
    "strip-edit-page-footers": _dropped(_i(prose.FOOTER)),
    "compress-api-parameter-trivia": _dropped(_i(prose.TRIVIA)),
    "strip-verification-boilerplate": _dropped(f"{_NOT('|>#')} and {_i('(?:' + prose.VERIFY + ')')}"),
    "strip-seo-chaff": _dropped(f"{_NOT('|#>')} and ({_i('(?:' + prose.SEO + ')')} or ({_WORDS} <= 12 and {_i('(?:' + prose.CRUMBS + ')')}) or ({_WORDS} <= 10 and {_i('(?:' + prose.NEXT + ')')}))"),
    "collapse-blank-lines": _rebuilt(
        ", z as (select *, lag(t = '' and not fenced) over (partition by path order by no) as b, max(case when t <> '' or fenced then no end) over (partition by path order by no rows between unbounded preceding and current row) as seen, "
        "max(case when t <> '' then no end) over (partition by path) as final from l), x as (select * from z)",
        keep="(t <> '' or fenced or (seen is not null and not coalesce(b, false))) and no <= final"),
    "strip-setext-headers": _rebuilt(
        ", y as (select *, lag(line) over (partition by path order by no) as prev, lag(t) over (partition by path order by no) as pt, lag(fenced) over (partition by path order by no) as pf, lead(fenced) over (partition by path order by no) as nf, lead(rtrim(line, ' ' || chr(9) || chr(13))) over (partition by path order by no) as nx from l), "
        "x as (select *, not fenced and not nf and t <> '' and substr(t, 1, 1) not in ('#', '|', '>') and regexp_matches(nx, '^(=+|-+)$') as head from y)",
        value="case when head then (case when substr(nx, 1, 1) = '=' then '# ' else '## ' end) || t else line end",
        keep="not coalesce(no > 1 and not fenced and not pf and pt <> '' and substr(pt, 1, 1) not in ('#', '|', '>') and regexp_matches(rtrim(line, ' ' || chr(9) || chr(13)), '^(=+|-+)$'), false)"),
    "normalize-unicode": _rebuilt(
        ", x as (select * from l)",
        value="case when fenced then line else replace(replace(replace(translate(line, '“”„‟«»‘’‚‛‹›–‒−•‣◦⁃\xa0\xad​', '\"\"\"\"\"\"''''''''''''---**** '), '—', '--'), '―', '--'), '…', '...') end"),
    "strip-url-tracking-params": _rebuilt(
        ", x as (select * from l)", value="case when fenced then line else replace(line, 'https://a.example.com/x?utm_source=feed&id=3', 'https://a.example.com/x?id=3') end"),
    "strip-frontmatter": f"with md as ({MD_DOCS}), z as (select *, strpos(substr(text, 4), '---') as c from md), a as (select path, text, case when starts_with(text, '---' || chr(10)) and c > 0 then regexp_replace(substr(text, c + 6), '^\\r?\\n', '') else text end as output from z) "
        "select path, md5(output) as output_md5, strlen(output)::bigint as bytes_after, (strlen(text) - strlen(output))::bigint as bytes_saved from a",
    "strip-admonition-prefixes": _rebuilt(
        ", x as (select * from l)",
        value=r"case when fenced or t = '' or substr(t, 1, 1) = '|' then line else regexp_replace(line, '^([ \t]*[> ]*)[*]{1,2}(?i:NOTE|WARNING):?[*]{1,2} *', '\1') end"),
}


def _lit(*lines: str) -> str:
    """SQL of lines that each end with a newline."""
    return " || ".join(f"'{x}' || {_NL}" if x else _NL for x in (v.replace("'", "''") for v in lines))


def _becomes(expr: str) -> str:
    return (
        f"with md as ({MD_DOCS}), a as (select path, text, {expr} as output from md) "
        "select path, md5(output) as output_md5, strlen(output)::bigint as bytes_after, (strlen(text) - strlen(output))::bigint as bytes_saved from a"
    )


def _replaced(*pairs: tuple[str, str]) -> str:
    expr = "text"
    for a, b in pairs:
        expr = f"replace({expr}, {a}, {b})"
    return _becomes(expr)


# The documents' own words have none of these shapes, so that what the rules do to the decorations is all they do.
_TICKS = "repeat(chr(96), 3)"
_HELLO = 'fmt.Println("hello world", 1)'
_TABLE = ("| Name | Count |", "|------|-------|", "| alpha   | 12   |", "| beta | 7 |")
_TOLD = "Here alpha has 12 and beta has 7."
_LICENSE = _lit("## License", "", "MIT", "", "<!-- end", "of it -->", "")
RULE_ORACLES |= {
    "strip-html-comments": _replaced((_lit("<!-- end", "of it -->", ""), "''")),
    "strip-badges": _replaced((_lit("[![build](https://img.shields.io/a.svg)](https://ci.example.com)"), "''")),
    "strip-decorative-images": _replaced((_lit("![logo](logo.png)"), "''")),
    "strip-toc": _replaced((_lit("## Contents", "", "- [One](#one)", "- [Two](#two)", ""), "''")),
    "strip-hedging-phrases": _replaced(("'Please note that this'", "'This'"), ("' in order to '", "' to '")),
    "strip-cross-references": _replaced(("' see the [guide](https://a.example.com/x?utm_source=feed&id=3) section.'", "''")),
    "compact-tables": _replaced((_lit(*_TABLE, "", _TOLD), _lit("| Name | Count |", "| alpha | 12 |", "| beta | 7 |", _TOLD))),
    "strip-benchmark-prose": _replaced((_lit(_TABLE[-1], "", _TOLD), _lit(_TABLE[-1]))),
    "compress-code-blocks": _replaced(
        (_lit('import "fmt"', "// says hello to the reader", _HELLO), _lit(_HELLO)), (_lit("# says hello"), "''")),
    "strip-html-wrappers": _replaced((_lit("<div>", "", "</div>", ""), _lit("", ""))),
    "collapse-example-output": _replaced((f"{_lit('tool --help', '')} || {_TICKS} || {_NL} || {_lit('usage: tool', '  --all   everything')} || {_TICKS} || {_NL}", _lit("tool --help", ""))),
    "truncate-large-code-blocks": _replaced((f"repeat('a line of code' || {_NL}, 24) || {_lit('the last line')}", f"repeat('a line of code' || {_NL}, 20) || {_lit('[... 5 more lines ...]')}")),
    "dedup-multilang-examples": _replaced((_lit("# says hello", 'print("hello world", 1)', "return value"), _lit("[equivalent to go example above]"))),
    "strip-boilerplate-sections": _replaced((_LICENSE, "''")),
    "strip-trailing-cta": _becomes(
        f"case when strpos(text, '## License') > 0 and strlen(substr(text, 1, strpos(text, '## License') - 1)) >= floor(strlen(text) * 0.7::double) then replace(text, {_LICENSE}, '') else text end"),
    "position-aware-budget": _becomes("text"),  # no document is long enough
}
for _r in RULES:
    if _r.apply is not None:
        query("rule_" + _r.name.replace("-", "_"), RULE_ORACLES.get(_r.name))(_rule_query(_r.name))


## duplicates over the corpus


@query("dup_paragraphs", rf"""with raw as (select doc_id, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as no from documents),
l as (select *, trim(line, ' ' || chr(9) || chr(13)) as t from raw), e as (select *, t <> '' and strpos('+*-|>#', substr(t, 1, 1)) = 0 and not regexp_matches(t, '^[0-9]+\. ') as ok from l),
g as (select *, sum(case when ok then 0 else 1 end) over (partition by doc_id order by no) as grp from e),
p as (select doc_id, min(no) as no, string_agg(line, chr(10) order by no) as body from g where ok group by doc_id, grp),
w as (select doc_id, no, strlen(body)::bigint as bytes, substr(sha256(lower(trim(regexp_replace(body, '[\t\n\f\r ]+', ' ', 'g')))), 1, 32) as key from p
    where len(list_filter(regexp_split_to_array(body, '[^\pL\p{{Nd}}]+'), lambda x: x <> '')) >= 30)
select key, count(*)::bigint as n, count(distinct doc_id)::bigint as n_docs, min(doc_id) as first_doc, sum(bytes)::bigint as bytes from w group by key having count(*) > 1""")
def dup_paragraphs(spark, sf):
    docs = store.spread(_table(spark, sf, "documents")).select(F.col("doc_id").cast("string").alias("path"), "text")
    u = pipeline.unit_table(pipeline.start(docs), "factor-cross-file-paragraphs").withColumn("doc_id", F.col("path").cast("bigint"))
    g = u.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("bytes").cast("bigint").alias("bytes"))
    return g.where("n > 1")


@query("dup_code", rf"""with {_L}, m as (select *, sum(case when regexp_matches(line, '^[ \t]*`{{3}}') then 1 else 0 end) over (partition by path order by no) as marks from l),
f as (select path, (marks + 1) // 2 as blk, min(no) as open_line, max(case when not fenced then regexp_extract(t, '^`+(.*)$', 1) end) as lang,
    string_agg(case when fenced and not regexp_matches(line, '^[ \t]*`{{3}}') and t <> '' then regexp_replace(t, '[\t\n\f\r ]+', ' ', 'g') end, chr(10) order by no) as body
    from m where fenced or regexp_matches(line, '^[ \t]*`{{3}}') group by path, (marks + 1) // 2),
c as (select path, open_line, lang, array_to_string(list_filter(string_split(body, chr(10)), lambda x: not starts_with(x, case lang when 'go' then '//' when 'python' then '#' else chr(0) end)), chr(10)) as body from f where body is not null)
select path, open_line::bigint as line, substr(sha256(lang || chr(10) || body), 1, 32) as key, first_value(path) over (partition by sha256(lang || chr(10) || body) order by path, open_line) as first_path from c where strlen(body) >= 20""")
def dup_code(spark, sf):
    u = pipeline.unit_table(pipeline.start(md_docs(spark, sf)), "dedup-cross-file-code-blocks")
    first = pipeline.first_places(u, "key")
    return u.join(first, "key").select("path", F.col("line").cast("bigint").alias("line"), "key", F.col("first.path").alias("first_path"))


@query("dup_sections", rf"""with {_L}, h as (select path, no, length(regexp_extract(t, '^(#{{1,6}}) ', 1)) as level from l where not fenced and regexp_matches(t, '^#{{1,6}} ')),
s as (select h.path, h.no, (select min(n.no) from h n where n.path = h.path and n.no > h.no and n.level <= h.level) as until from h),
b as (select s.path, s.no, string_agg(l.line || chr(10), '' order by l.no) as body from s join l on l.path = s.path and l.no > s.no and (s.until is null or l.no < s.until) group by all),
w as (select *, len(list_filter(regexp_split_to_array(body, '[^\pL\p{{Nd}}]+'), lambda x: x <> '')) as n, substr(sha256(lower(trim(regexp_replace(body, '[\t\n\f\r ]+', ' ', 'g')))), 1, 32) as key from b)
select path, no::bigint as line, strlen(body)::bigint as bytes, key, first_value(path) over (partition by key order by path, no) as first_path from w where n between 15 and 600""")
def dup_sections(spark, sf):
    u = pipeline.unit_table(pipeline.start(md_docs(spark, sf)), "strip-cross-file-dupes")
    return u.join(pipeline.first_places(u, "key"), "key").select("path", F.col("line").cast("bigint").alias("line"), F.col("bytes").cast("bigint").alias("bytes"), "key", F.col("first.path").alias("first_path"))


## phrases

_GRAMS = r"""w as (select doc_id, no, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda x: x <> '') as ws from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents)
    where not regexp_matches(line, '^[ \t]*([#>|]|[-*+] |[0-9]+\. |https?://|$)') and not contains(line, '`')),
g as (select unnest(list_transform(range(1, len(ws) - n + 2), lambda i: ws[i:i + n - 1])) as p from w, (select unnest([3, 4, 5, 6]) as n) where len(ws) >= n),
k as (select array_to_string(p, ' ') as phrase from g where len(list_filter(p, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) < 3 or regexp_matches(x, '[\[\](){}*_`<>|#~]'))) = 0),
c as (select phrase, count(*)::bigint as n from k where strlen(phrase) >= 15 group by phrase having count(*) >= 5)"""


@query("phrase_counts", f"with {_GRAMS} select phrase, n from c")
def phrase_counts(spark, sf):
    return phrasebook.phrase_counts(store.spread(_table(spark, sf, "documents")), 5)


@query("phrase_glossary", f"with {_GRAMS}, r as (select *, n * (strlen(phrase) - 2) as gross, row_number() over (order by n * (strlen(phrase) - 2) desc, phrase) as k from c) select 'T' || k as name, phrase, n, gross::bigint as gross from r where k <= 64")
def phrase_glossary(spark, sf):
    return phrasebook.glossary(phrasebook.phrase_counts(store.spread(_table(spark, sf, "documents")), 5)).withColumn("gross", F.col("gross").cast("bigint"))


## manifests and verdicts

_SAVED = "select url as source, ceil(strlen(html) / 4.0)::bigint as tokens_before, ceil(strlen(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) / 4.0)::bigint as tokens_after from pages"


def _page_manifest(spark, sf):
    h = F.col("html")
    return _table(spark, sf, "pages").select(F.col("url").alias("source"), T.token_estimate(h).alias("tokens_before"), T.token_estimate(T.comments_removed(h)).alias("tokens_after"))


@query("savings_totals", f"""with m as ({_SAVED}), s as (select count(*)::bigint as files, sum(tokens_before)::bigint as tokens_before, sum(tokens_after)::bigint as tokens_after from m)
select files, tokens_before, tokens_after, tokens_before - tokens_after as tokens_saved, round((tokens_before - tokens_after) * 100.0::double / tokens_before, 6) as percent, round((tokens_before - tokens_after) * 3e-6::double, 6) as usd from s""")
def savings_totals(spark, sf):
    return stats.totals(_page_manifest(spark, sf))


@query("top_savings", f"with m as ({_SAVED}) select source, tokens_before - tokens_after as tokens_saved from m where tokens_before > tokens_after order by 2 desc, 1 limit 10")
def top_savings(spark, sf):
    return stats.top_savings(_page_manifest(spark, sf))


@query("freshness", """with d as (select doc_id, doc_id::varchar as source, sha256(text) as now from documents),
m as (select source, case when doc_id % 5 = 1 then 'old' else now end as sha from d where doc_id % 7 <> 2 union all select 'gone' || doc_id, 'x' from d where doc_id % 50 = 0)
select coalesce(d.source, m.source) as source, case when m.sha is null then 'missing' when now = sha then 'fresh' else 'stale' end as state from d full join m on d.source = m.source""")
def freshness(spark, sf):
    docs = _table(spark, sf, "documents")
    named = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    sha = F.when(F.col("doc_id") % 5 == 1, "old").otherwise(F.sha2(F.col("text").cast("binary"), 256))
    have = docs.where("doc_id % 7 <> 2").select(F.col("doc_id").cast("string").alias("source"), sha.alias("sha256"))
    gone = docs.where("doc_id % 50 = 0").select(F.concat(F.lit("gone"), F.col("doc_id").cast("string")).alias("source"), F.lit("x").alias("sha256"))
    return stats.freshness(named, have.unionByName(gone))


def _verdicts(spark, sf):
    v = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").when(F.col("quality") == 1, "degraded").otherwise("fail")
    docs = _table(spark, sf, "documents").select("doc_id", F.col("source").alias("repo"))
    return _table(spark, sf, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), "repo", v.alias("verdict"), "toxic")


_V = "v as (select doc_id as id, source as repo, toxic, case when quality = 1 and toxic = 0 then 'pass' when quality = 1 then 'degraded' else 'fail' end as verdict from labels join documents using (doc_id))"


@query("verdict_tally", f"""with {_V} select repo, count(*) filter (verdict = 'pass')::bigint as n_pass, count(*) filter (verdict = 'degraded')::bigint as n_degraded, count(*) filter (verdict = 'fail')::bigint as n_fail,
    count(*)::bigint as total, grouping(repo)::tinyint as all_repos, round(count(*) filter (verdict = 'pass') / count(*), 6) as pass_rate from v group by rollup (repo)""")
def verdict_tally(spark, sf):
    return stats.verdict_tallies(_verdicts(spark, sf))


@query("ablation_delta", f"""with {_V}, r as (select 'rule' || k as rule, id, case when (id + k) % 6 = 0 then 'pass' when (id + k) % 11 = 0 then 'fail' else verdict end as verdict, verdict as base from v, (select unnest([0, 1, 2]) as k))
select rule, sum((verdict = 'pass')::int - (base = 'pass')::int)::bigint as pass_delta, sum((verdict = 'fail')::int - (base = 'fail')::int)::bigint as fail_delta,
    count(*) filter (verdict = 'pass' and base <> 'pass')::bigint as n_rescued, count(*) filter (verdict <> 'pass' and base = 'pass')::bigint as n_broke from r group by rule""")
def ablation_delta(spark, sf):
    base = _verdicts(spark, sf).select("id", "verdict")
    runs = base.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    changed = F.when((F.col("id") + F.col("k")) % 6 == 0, "pass").when((F.col("id") + F.col("k")) % 11 == 0, "fail").otherwise(F.col("verdict"))
    out = stats.ablation(base, runs.select(F.concat(F.lit("rule"), F.col("k").cast("string")).alias("rule"), "id", changed.alias("verdict")))
    return out.select("rule", "pass_delta", "fail_delta", F.size("rescued").cast("bigint").alias("n_rescued"), F.size("broke").cast("bigint").alias("n_broke"))


@query("rule_catalogue", "select * from (values " + ", ".join(f"({i}, '{r.name}', {r.tier}, {str(r.opt_in).lower()})" for i, r in enumerate(RULES, 1)) + ") t(position, name, tier, opt_in)")
def rule_catalogue(spark, sf):
    return spark.createDataFrame([(i, r.name, r.tier, r.opt_in) for i, r in enumerate(RULES, 1)], "position int, name string, tier int, opt_in boolean")


## everything


def _digest(df: DataFrame) -> DataFrame:
    return df.select("path", F.md5("output").alias("output_md5"), "bytes_before", "bytes_after", "tokens_before", "tokens_after", F.size("errors").alias("n_errors"))


@query("compress_safe")
def compress_safe(spark, sf):
    return _digest(pipeline.compress(md_docs(spark, sf), Options(SAFE)))


@query("compress_aggressive")
def compress_aggressive(spark, sf):
    return _digest(pipeline.compress(md_docs(spark, sf), Options(AGGRESSIVE)))


@query("compress_tree_glossary")
def compress_tree_glossary(spark, sf):
    return _digest(pipeline.compress(md_docs(spark, sf), Options(AGGRESSIVE, tree_glossary=True)))


@query("rule_profile")
def rule_profile(spark, sf):
    return stats.rule_profile(pipeline.compress(md_docs(spark, sf), Options(AGGRESSIVE)))
