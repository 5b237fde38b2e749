"""python -m vellum.cli compress FILE | run DIR OUT | status DIR OUT | profile DIR"""

from __future__ import annotations

import argparse
import sys

from vellum.operators.registry import RULES, Options, compress, parse_tier


def _options(a: argparse.Namespace) -> Options:
    return Options(parse_tier(a.tier), tuple(a.enable), tuple(a.disable), a.max_lines, a.compat, getattr(a, "tree_glossary", False))


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("vellum").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    p.add_argument("--tier", default="safe")
    p.add_argument("--enable", action="append", default=[], choices=[r.name for r in RULES])
    p.add_argument("--disable", action="append", default=[], choices=[r.name for r in RULES])
    p.add_argument("--max-lines", type=int, default=20)
    p.add_argument("--compat", action="store_true")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("rules")
    sub.add_parser("compress").add_argument("file", help="a file, or - for standard input")
    for verb in ("run", "status", "profile"):
        s = sub.add_parser(verb)
        s.add_argument("dir")
        if verb != "profile":
            s.add_argument("out")
        if verb == "run":
            s.add_argument("--tree-glossary", action="store_true")
    a = p.parse_args(argv)
    options = _options(a)
    if a.verb == "rules":
        for r in RULES:
            print(r.name, r.tier, "opt-in" if r.opt_in else "")
        return 0
    if a.verb == "compress":
        text = sys.stdin.read() if a.file == "-" else open(a.file, encoding="utf-8", newline="").read()
        out = compress(text, options, "" if a.file == "-" else a.file)
        sys.stdout.write(out.text)
        for name, n in out.saved.items():
            print(f"{name}: {out.fires[name]} times, {n} bytes", file=sys.stderr)
        return 1 if out.errors else 0
    from vellum.plans import pipeline, stats, store
    from vellum.sources import markdown

    spark = _spark()
    docs = markdown.read_tree(spark, a.dir)
    if a.verb == "profile":
        stats.rule_profile(pipeline.compress(docs, options)).orderBy("tokens_saved", "name", ascending=[False, True]).show(100, False)
        return 0
    manifest = f"{a.out}/manifest"
    if a.verb == "status":
        known = markdown.read_manifest(spark, manifest)
        stats.freshness(docs, known).groupBy("state").count().show()
        stats.totals(known).show(truncate=False)
        stats.top_savings(known).show(truncate=False)
        return 0
    docs = store.written(docs, "docs")
    results = store.written(pipeline.compress(docs, options), "results")
    markdown.write_results(results, f"{a.out}/documents")
    stats.manifest_of(results).write.mode("overwrite").parquet(manifest)
    stats.totals(results).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
