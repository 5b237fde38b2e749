"""The rules in their order, and the engine that applies them to one document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from vellum.operators import code, html, phrases, prose, tables
from vellum.operators.lines import Context, Edit, apply_edits, size

SAFE, AGGRESSIVE, MODEL = 1, 2, 3
TIERS = {"safe": SAFE, "aggressive": AGGRESSIVE, "llm": MODEL, "1": SAFE, "2": AGGRESSIVE, "3": MODEL, "": SAFE, "tier-1": SAFE, "tier-2": AGGRESSIVE, "tier-3": MODEL}


@dataclass(frozen=True)
class Rule:
    name: str
    tier: int
    apply: Callable[[str, Context], list[Edit]] | None  # None: needs the whole corpus
    opt_in: bool = False


RULES: list[Rule] = [
    Rule("strip-frontmatter", SAFE, prose.frontmatter),
    Rule("normalize-unicode", SAFE, prose.normalize_unicode),
    Rule("strip-url-tracking-params", SAFE, prose.url_tracking),
    Rule("strip-setext-headers", SAFE, prose.setext_headers),
    Rule("strip-html-comments", SAFE, html.html_comments),
    Rule("compress-code-blocks", SAFE, code.compress_code),
    Rule("strip-badges", SAFE, html.badges),
    Rule("strip-decorative-images", SAFE, html.decorative_images),
    Rule("strip-metadata-lines", SAFE, prose.metadata_lines),
    Rule("strip-horizontal-rules", SAFE, prose.horizontal_rules),
    Rule("strip-html-wrappers", AGGRESSIVE, html.html_wrappers),
    Rule("strip-toc", SAFE, prose.toc),
    Rule("strip-trailing-cta", SAFE, prose.trailing_cta),
    Rule("strip-cross-file-dupes", AGGRESSIVE, None),
    Rule("factor-cross-file-paragraphs", AGGRESSIVE, None),
    Rule("dedup-cross-file-code-blocks", AGGRESSIVE, None),
    Rule("truncate-large-code-blocks", AGGRESSIVE, code.truncate_code),
    Rule("position-aware-budget", AGGRESSIVE, code.middle_budget, True),
    Rule("dedup-multilang-examples", AGGRESSIVE, code.multilang),
    Rule("factor-phrase-dictionary", AGGRESSIVE, phrases.factor),
    Rule("strip-hedging-phrases", AGGRESSIVE, prose.hedging_phrases),
    Rule("dedup-cross-section", AGGRESSIVE, prose.cross_section, True),
    Rule("strip-benchmark-prose", AGGRESSIVE, tables.benchmark_prose),
    Rule("strip-admonition-prefixes", AGGRESSIVE, prose.admonition_prefixes),
    Rule("strip-cross-references", AGGRESSIVE, prose.cross_references),
    Rule("strip-mkdocs-includes", AGGRESSIVE, prose.mkdocs_includes),
    Rule("strip-edit-page-footers", AGGRESSIVE, prose.edit_page_footers),
    Rule("compress-api-parameter-trivia", AGGRESSIVE, prose.api_parameter_trivia),
    Rule("strip-boilerplate-sections", AGGRESSIVE, prose.boilerplate_sections, True),
    Rule("strip-verification-boilerplate", AGGRESSIVE, prose.verification_boilerplate),
    Rule("strip-seo-chaff", AGGRESSIVE, prose.seo_chaff),
    Rule("compress-changelogs", SAFE, prose.changelogs),
    Rule("collapse-example-output", AGGRESSIVE, code.example_output, True),
    Rule("compact-tables", SAFE, tables.compact_tables),
    Rule("collapse-blank-lines", SAFE, prose.blank_lines),
]
BY_NAME = {r.name: r for r in RULES}


def parse_tier(name: str | int) -> int:
    try:
        return TIERS[str(name).strip().lower()]
    except KeyError:
        raise ValueError(f"unknown tier {name!r}") from None


@dataclass(frozen=True)
class Options:
    """``enabled`` beats ``disabled``; opt-in rules run only if enabled."""

    tier: int = SAFE
    enabled: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    max_lines: int = 20
    compat: bool = False
    tree_glossary: bool = False
    plugins: tuple = ()

    def rules(self) -> list[Rule]:
        off = {r.name for r in RULES if r.opt_in} | set(self.disabled)
        return [r for r in RULES if r.tier <= self.tier and (r.name in self.enabled or r.name not in off)]


@dataclass(frozen=True)
class Plugin:
    """A user's rule: the whole text in, the whole text out.  Its output must not exceed twice the input (1024
    bytes for an empty one), else it is an error and the text stays."""

    name: str
    apply: Callable[[str], str]
    tier: int = SAFE


@dataclass
class Outcome:
    text: str
    fires: dict[str, int] = field(default_factory=dict)
    saved: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def take(self, name: str, edits: list[Edit]) -> None:
        if edits:
            new = apply_edits(self.text, edits)
            self.fires[name] = self.fires.get(name, 0) + len(edits)
            self.saved[name] = self.saved.get(name, 0) + size(self.text) - size(new)
            self.text = new


def run(state: Outcome, rules: list[Rule], ctx: Context) -> Outcome:
    """Each rule sees what the one before left.  A rule that fails is noted, and the text stays."""
    for rule in rules:
        if rule.apply is None:
            continue
        try:
            state.take(rule.name, rule.apply(state.text, ctx))
        except Exception as e:  # a rule must not end the job
            state.errors[rule.name] = f"{type(e).__name__}: {e}"[:500]
    return state


def run_plugins(state: Outcome, plugins, tier: int) -> Outcome:
    for p in plugins:
        if p.tier > tier:
            continue
        try:
            new = p.apply(state.text)
            new.encode()
            if size(new) > max(2 * size(state.text), 1024 if not state.text else 0):
                raise ValueError("the output is more than twice the input")
        except Exception as e:
            state.errors[p.name] = f"{type(e).__name__}: {e}"[:500]
            continue
        if new != state.text:
            state.fires[p.name] = 1
            state.saved[p.name] = size(state.text) - size(new)
            state.text = new
    return state


def compress(text: str, options: Options = Options(), path: str = "") -> Outcome:
    """One document by itself; rules that need a corpus do nothing."""
    state = run(Outcome(text), options.rules(), Context(options.tier, path, options.max_lines, options.compat))
    return run_plugins(state, options.plugins, options.tier)
