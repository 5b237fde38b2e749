"""Column functions over texts and lines; each has a DuckDB counterpart in vellum.queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate_of(n_bytes: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(n_bytes / 4).cast("bigint")


def token_estimate(text: Column) -> Column:
    return token_estimate_of(F.octet_length(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]+")).cast("bigint")


def lines(text: Column) -> Column:
    """Lines without newlines; a final newline starts no further line, an empty text has none."""
    all_ = F.split(text, "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)


def fence_mark(line: Column) -> Column:
    """The first character of a line's fence, or nothing."""
    return F.substring(F.regexp_extract(line, r"^[ \t]*(`{3}|~{3})", 1), 1, 1)


#: Lines that fenced() looks at in one run.
RUN = 256


def fenced(lines_: Column) -> Column:
    """For each line, whether it is inside a fence: the state before the line, so an opening fence is outside.  Lines are
    taken in runs, as appending to one long array would take the square of its length."""
    none = F.array().cast("array<boolean>")

    def step(acc: Column, x: Column) -> Column:
        mark = fence_mark(x)
        now = F.when(mark == "", acc["open"]).when(acc["open"] == "", mark).when(acc["open"] == mark, F.lit("")).otherwise(acc["open"])
        return F.struct(now.alias("open"), F.concat(acc["out"], F.array(acc["open"] != "")).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        start = F.struct(acc["open"].alias("open"), none.alias("out"))
        return F.aggregate(part, start, step, lambda own: F.struct(own["open"].alias("open"), F.concat(acc["out"], own["out"]).alias("out")))

    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines_), F.lit(1)), F.lit(RUN)), lambda k: F.slice(lines_, k, RUN))
    return F.aggregate(runs, F.struct(F.lit("").alias("open"), none.alias("out")), run, lambda acc: acc["out"])


def sentence_count(text: Column) -> Column:
    n = F.length(text) - F.length(F.translate(text, ".!?", ""))
    return F.when((n == 0) & (F.trim(text) != ""), F.lit(1)).otherwise(n).cast("bigint")


def short_hash(text: Column, digits: int = 32) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def clean_url(url: Column) -> Column:
    """Without tracking parameters."""
    gone = F.regexp_replace(url, r"[?&](?:utm_[a-z_]+|(?:fb|g)clid|[gw]braid|yclid|msclkid|mc_[ce]id|igshid|_g[al]|ref(?:_src)?|si)=[^&#\t\n\f\r )>\]]*", "")
    head, tail = F.regexp_extract(gone, "^[^?&]*", 0), F.regexp_replace(gone, "^[^?&]*", "")
    tail = F.regexp_replace(tail, r"^(?:\?&*|&)", "\u0001")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"\?", ""), "&+", "&"), "\u0001", "?")
    return F.when(gone == url, url).otherwise(F.regexp_replace(F.concat(head, tail), r"[?&]+$", ""))


def comments_removed(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


def percent_saved(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) * 100.0 / before).otherwise(0.0)
