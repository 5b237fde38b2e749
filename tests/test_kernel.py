"""Rules on single documents: hits, no-ops, fences, edits; on our own fixtures."""

import random

import pytest

from vellum.operators import lines as L
from vellum.operators import phrases, prose, units
from vellum.operators.registry import AGGRESSIVE, BY_NAME, RULES, SAFE, Options, Plugin, compress, parse_tier
from vellum.plans.evaluate import alone, json_part, not_found, questions_of, score_of, verdict_of


def one(rule, text, path="", **kw):
    o = alone(rule)
    out = compress(text, Options(o.tier, o.enabled, o.disabled, **kw), path)
    assert not out.errors
    return out.text


HITS = [
    ("strip-frontmatter", "---\na: 1\n---\ntext\n", "text\n"),
    ("strip-frontmatter", "+++\r\na\r\n+++\r\nx", "x"),
    ("strip-frontmatter", "---\nnever closed", "---\nnever closed"),
    ("normalize-unicode", "“a” — b… `“c”`\n", '"a" -- b... `“c”`\n'),
    ("strip-url-tracking-params", "[x](https://e.org/?utm_a=1&q=2&gclid=3) https://e.org/?fbclid=9", "[x](https://e.org/?q=2) https://e.org/"),
    ("strip-setext-headers", "A\n==\n\nB\n--\nc\n", "# A\n\n## B\nc\n"),
    ("strip-html-comments", "a <!-- b --> c\n<!-- own\nline -->\n\nd\n", "a  c\nd\n"),
    ("strip-html-comments", "x <!-- open", "x <!-- open"),
    ("compress-code-blocks", "```sh\n$ ls -l\nout\n$ pwd\n```\n", "```sh\nls -l\nout\npwd\n```\n"),
    ("compress-code-blocks", "```yaml\n# only a comment\n\n```\nz\n", "z\n"),
    ("compress-code-blocks", '```python\nimport os\n"""doc"""\nx = 1\n```\n', "```python\nx = 1\n```\n"),
    ("compress-code-blocks", "```js\nglob('src/*.js')\nrun()\n```\n", "```js\nglob('src/*.js')\nrun()\n```\n"),
    ("strip-badges", "[![b](https://img.shields.io/x)](y)\nt ![c](https://codecov.io/z) u\n", "t  u\n"),
    ("strip-badges", "![ci][b]\n\n[b]: https://travis-ci.org/x\n", "\n"),
    ("strip-badges", "![a long and telling text about the picture](https://shields.io/x)\n", "![a long and telling text about the picture](https://shields.io/x)\n"),
    ("strip-decorative-images", "![logo](a.png)\n![diagram of the whole system](b.png)\n<p><img src='hero.png' alt='the long text of it all'></p>\n", "![diagram of the whole system](b.png)\n\n"),
    ("strip-metadata-lines", "Author: me\nLicense: MIT, updated: x\nVersion 2\ntext: y\n", "License: MIT, updated: x\nVersion 2\ntext: y\n"),
    ("strip-horizontal-rules", "a\n\n***\nb\n---\n", "a\n\nb\n"),
    ("strip-html-wrappers", "<div>\n\n</div>\n<details>\nx\n</details>\n", "\n<details>\nx\n</details>\n"),
    ("strip-toc", "# T\n## Contents\n- [a](#a)\n\n- [b](#b)\nnext\n", "# T\nnext\n"),
    ("strip-toc", "## Contents\n- a\n- [b](#b)\n", "## Contents\n- a\n- [b](#b)\n"),
    ("strip-trailing-cta", "# A\n" + "word " * 40 + "\n## Star us\nplease\n", "# A\n" + "word " * 40 + "\n"),
    ("truncate-large-code-blocks", "```\n" + "line of code\n" * 25 + "```\n", "```\n" + "line of code\n" * 20 + "[... 5 more lines ...]\n```\n"),
    ("dedup-multilang-examples", "```go\nprint hello world\nreturn value\n```\n```js\nprint hello world\nreturn value\n```\n", "```go\nprint hello world\nreturn value\n```\n```js\n[equivalent to go example above]\n```\n"),
    ("strip-hedging-phrases", "Please note that it works. Use it in order to win. `in order to`\n", "It works. Use it to win. `in order to`\n"),
    ("strip-hedging-phrases", "In order to win, go.\n", "To win, go.\n"),
    ("strip-admonition-prefixes", "**NOTE:** x\n> **Tip** y\n**Notebook** z\n", "x\n> y\n**Notebook** z\n"),
    ("strip-cross-references", "It is so, see the [guide](g.md) page. Next\n", "It is so Next\n"),
    ("strip-mkdocs-includes", "--8<-- a\n{!b!}\nc\n", "c\n"),
    ("strip-edit-page-footers", "## Edit this page\nLast updated by me\nlast updatedness\n", "last updatedness\n"),
    ("compress-api-parameter-trivia", "- **Default**: None\n- Required = yes.\n- Default: 3\n", "- Default: 3\n"),
    ("strip-boilerplate-sections", "# A\nx\n## Contributing\nPlease read how to contribute.\n", "# A\nx\n"),
    ("strip-verification-boilerplate", "You should see a list\nThe output is:\nThe output is 4\n", "The output is 4\n"),
    ("strip-seo-chaff", "On this page:\nNext: more\nHome > Docs > X\ntext here\n", "text here\n"),
    ("compress-changelogs", "# Changelog\n## 1.2.0 (2024-01-02)\nMay 1, 2024\n- fix ([#1](u), [#2](v)) (@me)\n", "# Changelog\n## 1.2.0\n- fix\n"),
    ("collapse-example-output", "tool --help\n\n```\nusage: tool\n  --a  b\n```\nz\n", "tool --help\n\nz\n"),
    ("compact-tables", "| a    | b |\n|------|---|\n| 1 \\| 2 | 3  |\n", "| a | b |\n| 1 \\| 2 | 3 |\n"),
    ("collapse-blank-lines", "\n\na\n\n\n\nb\n```\n\n\n```\n\n\n", "a\n\nb\n```\n\n\n```\n"),
    ("strip-benchmark-prose", "| Name | Ms |\n|---|---|\n| alpha | 12 |\n\nAlpha took 12 ms.\n\nOther.\n", "| Name | Ms |\n|---|---|\n| alpha | 12 |\n\nOther.\n"),
    ("dedup-cross-section", "# T\nThe cache keeps recent parsed files in memory.\n## B\n### C\nInternally the cache keeps all recent parsed files in memory so that later runs start fast.\n",
     "# T\n\n## B\n### C\nInternally the cache keeps all recent parsed files in memory so that later runs start fast.\n"),
]


@pytest.mark.parametrize("rule,text,want", HITS)
def test_hits(rule, text, want):
    assert one(rule, text) == want


@pytest.mark.parametrize("rule", [r.name for r in RULES])
def test_nothing_to_do_and_fences(rule):
    for text in ("", "plain words only\n", "```\n\n```\n", "```\nunclosed\n\n\nAuthor: x"):
        if rule != "collapse-example-output":
            assert one(rule, text) == text
    if rule not in ("compress-code-blocks",):
        fenced = "a\n\n```\n---\nAuthor: x\n**NOTE:** in order to see the [a](b)\n<!-- c -->\n![logo](x)\nOn this page\n```\nb\n"
        assert one(rule, fenced) == fenced


def test_compat_keeps_the_quirks():
    assert one("strip-setext-headers", "A\n=\nb\n", compat=True) == "# Ab\n"
    assert one("strip-html-wrappers", "<div>\nx\n</div>\n", compat=True) == "<div>\nx\n"
    assert one("compact-tables", "| a      | b |\n|---|---|\n| 1 \\| 2 | 3 |\n", compat=True) == "| a | b |\n| 1 \\ | 2 | 3 |\n"


def test_middle_of_long_documents():
    block = "```\n" + "code line\n" * 12 + "```\n"
    doc = block + "x\n" * 100 + block + "y\n" * 100 + block
    assert one("position-aware-budget", doc).count("[... 4 more lines ...]") == 1


def test_edits():
    src = "0123456789"
    assert L.apply_edits(src, []) == src
    assert L.apply_edits(src, [L.Edit(5, 7), L.Edit(1, 3), L.Edit(2, 4)]) == "0" + "4" + "789"
    assert L.apply_edits(src, [L.Edit(2, 4, "x"), L.Edit(3, 6)]) == "01x456789"
    assert L.apply_edits(src, [L.Edit(2, 4, "x"), L.Edit(2, 2, "<"), L.Edit(-5, 1), L.Edit(9, 99, "!")]) == "1<x45678!"
    rng = random.Random(0)
    for _ in range(300):
        edits = [L.Edit(a, a + rng.randint(0, 4)) for a in rng.sample(range(10), rng.randint(0, 5))]
        gone = {i for e in edits for i in range(e.start, min(e.end, 10))}
        assert L.apply_edits(src, edits) == "".join(c for i, c in enumerate(src) if i not in gone)


def test_lines_and_blocks():
    lines = L.split_lines("x\n```go\ny\n~~~\n```\nz\n")
    assert [x.fenced for x in lines] == [False, False, True, True, True, False]
    assert [(b.first, b.last) for b in L.blocks_of(lines)] == [(1, 4)]
    assert L.split_lines("") == [] and len(L.split_lines("a\n")) == 1
    assert L.blocks_of(L.split_lines("```\nopen\n")) == []
    assert L.count_words("a-b 12 é_ß 日本") == 6 and L.language_of("  ```Go x") == "go"


def test_only_lines_with_a_phrase_are_cut_into_words(monkeypatch):
    seen, real = [], phrases.runs
    monkeypatch.setattr(phrases, "runs", lambda lines, compat: seen.extend(x.text for x in lines) or real(lines, compat))
    text = "nothing of it in here\nan alpha  beta\tgamma delta\nalpha `x` beta gamma\nalpha beta, gamma\n"
    for compat, want in ((False, [1]), (True, [1, 2])):
        seen.clear()
        ctx = L.Context(2, "x", 20, compat, {"alpha beta gamma delta": "T1", "alpha beta gamma": "T2"}, "")
        edits = phrases.factor(text, ctx)
        assert seen == [text.split("\n")[i] for i in want] and [e.text for e in edits] == ["T1", "T2"][:len(want)]


def test_phrases():
    text = "alpha beta gamma delta is good\n" * 6
    out = one("factor-phrase-dictionary", text)
    assert out.startswith("[gloss] T1=") and out.count("T1") == 7 and len(out) < len(text)
    for same in ("- alpha beta gamma delta\n" * 6, "# alpha beta gamma delta\n" * 6, "```\n" + "alpha beta gamma delta\n" * 6 + "```\n"):
        assert one("factor-phrase-dictionary", same) == same
    split = "alpha beta `code` gamma delta\n" * 6
    assert one("factor-phrase-dictionary", split) == split


def test_order_of_rules():
    at = {r.name: i for i, r in enumerate(RULES)}
    assert len(RULES) == 35 and sum(r.tier == SAFE for r in RULES) == 15 and sum(r.opt_in for r in RULES) == 4
    code = [k for k in at if "code-blocks" in k]
    assert [k.split("-")[0] for k in sorted(code, key=at.get)] == ["compress", "dedup", "truncate"]
    assert at["strip-frontmatter"] < at["strip-setext-headers"] < at["strip-horizontal-rules"] and at["strip-benchmark-prose"] < at["compact-tables"]
    assert RULES[-1].name == "collapse-blank-lines"


def test_options_and_plugins():
    assert parse_tier("Aggressive") == AGGRESSIVE and parse_tier("") == SAFE
    with pytest.raises(ValueError):
        parse_tier("x")
    assert "strip-toc" not in [r.name for r in Options(disabled=("strip-toc",)).rules()]
    assert "dedup-cross-section" in [r.name for r in Options(AGGRESSIVE, ("dedup-cross-section",)).rules()]
    plugins = (Plugin("up", str.upper), Plugin("big", lambda s: s * 3), Plugin("bad", lambda s: 1 / 0), Plugin("late", str.lower, AGGRESSIVE))
    out = compress("abc", Options(plugins=plugins))
    assert out.text == "ABC" and set(out.errors) == {"big", "bad"} and out.fires == {"up": 1}


def test_shapes():
    a, b = "See https://x.org v1.2.3 and `run` 17 times", "See https://y.net v2.0 and `go` 9 times"
    assert units.text_shape(a) == units.text_shape(b)
    assert units.code_shape('x = "a" + 1', "go") == units.code_shape('x = "b" + 22', "go")


def test_replies():
    assert verdict_of('so: {"verdict": "Pass"}') == "pass" and verdict_of("?") == "fail"
    assert score_of('{"score": 0.75}') == 0.75 and score_of("about 0.5.") == 0.5 and score_of("7") is None
    assert not_found("NOT FOUND.") and not not_found("found")
    assert questions_of('["a?", {"text": "b?"}]') == ["a?", "b?"] and questions_of("1. Why?\n- So\n") == ["Why?"]
    assert json_part("[1]") == {}
