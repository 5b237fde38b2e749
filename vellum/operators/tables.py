"""Rules for pipe tables."""

from __future__ import annotations

from vellum.operators.lines import Context, Edit, Line, heading, rx, size, split_lines, trim, _letter
from vellum.operators.prose import is_prose

LOOSE = r"\|?[~S:-]+\|[~S|:-]+\|?$"
_GENERIC = frozenset("after before name project reduction repo saved saving savings token tokens total totals".split())


def _row(t: str) -> bool:
    return "|" in t and t[0] not in ">#" and not t.startswith("```")


def strict_delimiter(text: str) -> bool:
    cells = trim(text).strip("|").split("|")
    return all("-" in c and not trim(c).strip("-: ") for c in cells)


def compact_row(t: str, compat: bool = False) -> str:
    """Outside compat mode an escaped pipe is part of its cell."""
    row = t if compat else t.replace("\\|", "\0")
    out = " | ".join(trim(c) for c in row.strip("| ").split("|"))
    return (("| " if row[0] == "|" else "") + out + (" |" if row[-1] == "|" else "")).replace("\0", "\\|")


def compact_tables(src: str, ctx: Context) -> list[Edit]:
    """Delimiter rows go, cells are trimmed; blank lines inside and after a table go with it."""
    if "|" not in src:
        return []
    lines, out, i = split_lines(src), [], 0
    while i < len(lines):
        t = trim(lines[i].text)
        start = i
        i += 1
        if lines[start].fenced or not t or not _row(t) or i >= len(lines) or not rx(LOOSE).match(trim(lines[i].text)):
            continue
        end = i + 1
        while end < len(lines):
            row = trim(lines[end].text)
            if row and not lines[end].fenced and not _row(row):
                break
            end += 1
        if end - start >= 3:
            rows = [trim(x.text) for x in lines[start:end]]
            new = "\n".join(compact_row(r, ctx.compat) for r in rows if r and not rx(LOOSE).match(r)) + "\n"
            old = src[lines[start].start:lines[end - 1].end]
            if size(new) < size(old):
                out.append(Edit(lines[start].start, lines[end - 1].end, new))
        i = end
    return out


def _cell(s: str) -> str:
    return " ".join("".join(c if _letter(c) or c in ".%-" else " " for c in trim(s).lower()).split())


def _table_at(lines: list[Line], i: int) -> bool:
    if i + 1 >= len(lines) or lines[i].fenced or lines[i + 1].fenced:
        return False
    t = trim(lines[i].text)
    return "|" in t and t[0] != ">" and strict_delimiter(lines[i + 1].text)


def benchmark_prose(src: str, ctx: Context) -> list[Edit]:
    """A short paragraph beside a table that only says what the table's cells say."""
    if "|" not in src:
        return []
    lines, found, i = split_lines(src), [], 0
    while i < len(lines):
        t = trim(lines[i].text)
        if lines[i].fenced or not t:
            i += 1
        elif _table_at(lines, i):
            start = i
            i += 2
            while i < len(lines) and not lines[i].fenced and "|" in lines[i].text and trim(lines[i].text)[0] != ">":
                i += 1
            cells = [c for k, x in enumerate(lines[start:i]) if k != 1 for c in map(_cell, trim(x.text).strip("|").split("|")) if c and c not in _GENERIC]
            found.append(("table", start, i, cells))
        elif not is_prose(t):
            i += 1
        else:
            start = i
            while i < len(lines) and not lines[i].fenced and is_prose(trim(lines[i].text)) and not _table_at(lines, i):
                i += 1
            found.append(("text", start, i, " ".join(trim(x.text) for x in lines[start:i])))
    out = []
    for k, (kind, start, end, body) in enumerate(found):
        if kind == "table" or sum(body.count(c) for c in ".!?") > 3:
            continue
        near = [found[j] for j in (k - 1, k + 1) if 0 <= j < len(found) and found[j][0] == "table"]
        if not near or not near[0][3]:
            continue
        _, t_start, t_end, cells = near[0]
        told = _cell(body)
        if sum(c in told for c in cells) >= 0.6 * len(cells):
            if t_end <= start:
                out.append(Edit(lines[t_end - 1].end, lines[end - 1].end))
            else:
                out.append(Edit(lines[start].start, lines[t_start].start))
    return out
