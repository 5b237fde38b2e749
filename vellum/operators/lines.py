"""Lines, fences, blocks and edits of one Markdown document (plain Python, no Spark).

Offsets count characters of the text; whatever is a size (thresholds, savings) counts UTF-8 bytes.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

#: A link's address in parentheses, and its text in brackets.
TARGET, LABEL = r"\([^)]+\)", r"\[[^\]]+\]"
#: White space as Unicode has it, without the separators U+001C to U+001F.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"


@lru_cache(maxsize=None)
def rx(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern with ASCII classes; ``~s`` stands for white space without vertical tab, also in brackets
    (as ``~S`` for those characters alone)."""
    return re.compile(pattern.replace("~s", "[\t\n\x0c\r ]").replace("~S", "\t\n\x0c\r "), flags | re.ASCII)


def rxi(pattern: str) -> re.Pattern:
    return rx(pattern, re.IGNORECASE)


def trim(s: str) -> str:
    return s.strip(BLANKS)


def squeeze(s: str) -> str:
    """Words joined by single spaces."""
    return " ".join(x for x in re.split(f"[{BLANKS}]+", s) if x)


def size(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode())


def _letter(ch: str) -> bool:
    return unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")


class _OnlyLetters(dict):
    """For str.translate: what isn't a letter or digit becomes a blank; characters are looked up once."""

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code) if _letter(chr(code)) else " "
        return out


_ONLY_LETTERS = _OnlyLetters()


def words(s: str) -> list[str]:
    """Maximal runs of letters and decimal digits."""
    if s.isascii():
        return re.findall("[A-Za-z0-9]+", s)
    return s.translate(_ONLY_LETTERS).split()


def count_words(s: str) -> int:
    return len(words(s))


class Line(NamedTuple):
    start: int
    end: int  # with its newline
    text: str  # without
    fenced: bool  # the state before the line: an opening line is outside, a closing one inside


class Block(NamedTuple):
    first: int  # line of the opening fence
    last: int  # line of the closing fence
    start: int
    end: int
    body: list[Line]


class Edit(NamedTuple):
    start: int
    end: int
    text: str = ""


def fence_of(text: str) -> str:
    """The fence's character, or nothing."""
    s = text.lstrip(" \t")
    return s[0] if s[:3] in ("```", "~~~") else ""


@lru_cache(maxsize=4)  # rules that leave a text as it is follow one another
def split_lines(src: str) -> list[Line]:
    out, at, open_ = [], 0, ""
    n = len(src)
    while at < n:
        cut = src.find("\n", at)
        end = n if cut < 0 else cut + 1
        text = src[at:n if cut < 0 else cut]
        out.append(Line(at, end, text, bool(open_)))
        mark = fence_of(text) if "`" in text or "~" in text else ""
        if mark and not open_:
            open_ = mark
        elif mark and mark == open_:
            open_ = ""
        at = end
    return out


def blocks_of(lines: list[Line]) -> list[Block]:
    """Closed fenced blocks."""
    out, opened = [], -1
    for i, line in enumerate(lines):
        mark = fence_of(line.text)
        if not line.fenced:
            opened = i if mark else -1
        elif mark and opened >= 0 and mark == fence_of(lines[opened].text):
            out.append(Block(opened, i, lines[opened].start, line.end, lines[opened + 1:i]))
            opened = -1
    return out


def language_of(fence: str) -> str:
    rest = fence.strip(" \t\r").lstrip("`~").split()
    return rest[0].lower() if rest else ""


def heading(trimmed: str) -> tuple[int, str] | None:
    """Level and text of an ATX heading."""
    level = len(trimmed) - len(trimmed.lstrip("#"))
    if 1 <= level <= 6 and trimmed[level:level + 1] == " ":
        return level, trim(trimmed[level + 1:])
    return None


def in_code(text: str, at: int) -> bool:
    return text.count("`", 0, at) % 2 == 1


def whole(line: Line) -> Edit:
    return Edit(line.start, line.end)


def apply_edits(src: str, edits: list[Edit]) -> str:
    """Edits sorted by start, inserts first, in their given order otherwise.  Of overlapping edits two
    deletions are joined; else the later one is dropped."""
    n = len(src)
    clean = []
    for e in edits:
        s, z = min(max(e.start, 0), n), min(max(e.end, 0), n)
        if s < z or (s == z and e.text):
            clean.append(Edit(s, z, e.text))
    clean.sort(key=lambda e: (e.start, e.end != e.start))
    kept: list[Edit] = []
    for e in clean:
        if kept and e.start < kept[-1].end:
            if not e.text and not kept[-1].text:
                kept[-1] = Edit(kept[-1].start, max(kept[-1].end, e.end))
            continue
        kept.append(e)
    out, at = [], 0
    for e in kept:
        out += (src[at:e.start], e.text)
        at = e.end
    out.append(src[at:])
    return "".join(out)


@dataclass
class Context:
    """What a rule may know beside the text."""

    tier: int = 1
    path: str = ""
    max_lines: int = 20
    compat: bool = False
    glossary: dict[str, str] = field(default_factory=dict)
    glossary_line: str = ""  # the preamble, in the anchor document only


def cut_lines(body: list[Line], keep: int) -> list[Edit]:
    """Lines beyond ``keep`` become one marker, if that is shorter."""
    if len(body) <= keep:
        return []
    start, end = body[keep].start, body[-1].end
    mark = f"[... {len(body) - keep} more lines ...]\n"
    room = sum(size(x.text) for x in body[keep:]) + sum(x.end - x.start - len(x.text) for x in body[keep:])
    return [Edit(start, end, mark)] if size(mark) < room else []
