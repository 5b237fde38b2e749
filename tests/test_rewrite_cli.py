"""The model tier with scripted models, and the command line."""

import pytest

from vellum import cli
from vellum.plans import rewrite

LONG = ("some words that go on and on, " * 40).strip()


def models(score=1.0):
    return rewrite.Models(lambda p: "```\nshorter\n```" if "LOSSY" not in p else "x", lambda p: f'{{"score": {0.1 if "LOSSY" in p else score}}}')


def test_only_long_prose_is_offered():
    src = f"# T\n\n{LONG}\n\nshort\n\n```\n{LONG}\n```\n\n- {LONG}\n"
    assert [src[s:e] for s, e in rewrite.offered(src)] == [LONG]


def test_rewrites_are_judged_and_kept(spark):
    docs = spark.createDataFrame([("a", f"# T\n\n{LONG}\n\nend\n"), ("b", f"{LONG}\n"), ("c", f"LOSSY {LONG}\n"), ("d", None)], "path string, text string")
    out, cache = rewrite.rewrite(docs, models())
    assert {r.path: r.text for r in out.collect()} == {"a": "# T\n\nshorter\n\nend\n", "b": "shorter\n", "c": f"LOSSY {LONG}\n", "d": None}
    assert cache.count() == 2

    def never(prompt):
        raise AssertionError("asked again")

    again, _ = rewrite.rewrite(docs, rewrite.Models(never, never), cache)
    assert {r.path: r.text for r in again.collect()}["b"] == "shorter\n"
    out, _ = rewrite.rewrite(docs, models(0.5))
    assert {r.path: r.text for r in out.collect()}["b"] == f"{LONG}\n"


def test_a_judge_is_needed():
    with pytest.raises(ValueError):
        rewrite.Models(str, str, "m", "m")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("Author: x\n\n\n\ntext\n")
    assert cli.main(["compress", str(tmp_path / "in" / "a.md")]) == 0
    assert capsys.readouterr().out == "text\n"
    assert cli.main(["--tier", "aggressive", "run", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "documents")).first().output == "text\n"
    assert cli.main(["status", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert "fresh" in capsys.readouterr().out
    assert cli.main(["profile", str(tmp_path / "in")]) == 0
    assert cli.main(["rules"]) == 0
