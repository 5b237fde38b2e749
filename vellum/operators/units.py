"""Sections, paragraphs and code blocks of a document, with the keys by which a corpus shares them."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from vellum.operators.code import COMMENT, DUPLICATE
from vellum.operators.lines import TARGET, blocks_of, count_words, heading, language_of, rx, size, split_lines, squeeze, trim


class Unit(NamedTuple):
    start: int
    end: int
    bytes: int
    key: str
    shape: str  # key of the text's structure, empty if it has none
    line: int  # 1-based line of a block's opening fence
    ok: bool  # whether the unit may be replaced


def _key(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()[:32]


_QUOTED = "\"[^\"\n]*\"|'[^'\n]*'"
_DIGITS = "[0-9]+"
_VERSION = rf"\bv?{_DIGITS}(?:[.]{_DIGITS}){{1,3}}(?:[-.][a-z0-9]+)*\b"
_HEX, _NUMBER = r"\b0x[0-9a-f]+\b", rf"\b{_DIGITS}\b"
_TEXT_SHAPE = (
    (r"https?://[^~S)\]]+", " <url> "), (rf"\[([^\]]+)\]{TARGET}", r" \1 "), (rf"!\[[^\]]*\]{TARGET}", " "), ("`[^`]+`", " <code> "),
    (_VERSION, " <ver> "), (_HEX, " <hex> "), (_NUMBER, " <num> "), (_QUOTED, " <str> "), (r"(?:[-\w.]+/){2,}[-\w.]*", " <path> "),
)
_CODE_SHAPE = ((_QUOTED, " <s> "), (_VERSION, " <v> "), (_HEX, " <h> "), (_NUMBER, " <n> "))


def text_shape(s: str) -> str:
    s = trim(s).lower()
    for pattern, by in _TEXT_SHAPE:
        s = rx(pattern).sub(by, s)
    return squeeze(s)


def code_shape(s: str, lang: str) -> str:
    s, mark = s.lower(), COMMENT.get(lang)
    if mark:
        s = "\n".join(t for x in s.split("\n") if (t := trim(x)) and not t.startswith(mark))
    for pattern, by in _CODE_SHAPE:
        s = rx(pattern).sub(by, s)
    return squeeze(s)


def sections(src: str) -> list[Unit]:
    """Bodies of 15 to 600 words, from a heading to the next of its level or a higher one; they nest."""
    lines, out = split_lines(src), []
    heads = [(i, h[0]) for i, x in enumerate(lines) if not x.fenced and "#" in x.text and (h := heading(trim(x.text)))]
    for k, (i, level) in enumerate(heads):
        nxt = next((j for j, other in heads[k + 1:] if other <= level), None)
        start = lines[i].end
        end = lines[nxt].start if nxt is not None else lines[-1].end
        body = src[start:end]
        if end > start and 15 <= count_words(body) <= 600:
            n = size(body)
            out.append(Unit(start, end, n, _key(squeeze(body.lower())), _key("section\0" + text_shape(body)) if n >= 256 else "", i + 1, True))
    return out


def _prose(t: str) -> bool:
    return bool(t) and t[0] not in "#>|-*+" and not rx(r"\d+\. ").match(t)


def paragraphs(src: str) -> list[Unit]:
    """Runs of prose lines with at least 30 words."""
    lines, out, i = split_lines(src), [], 0
    while i < len(lines):
        if lines[i].fenced or not _prose(trim(lines[i].text)):
            i += 1
            continue
        first = i
        while i < len(lines) and not lines[i].fenced and _prose(trim(lines[i].text)):
            i += 1
        start, end = lines[first].start, lines[i - 1].start + len(lines[i - 1].text)
        body = src[start:end]
        if count_words(body) >= 30:
            out.append(Unit(start, end, size(body), _key(squeeze(body.lower())), "", first + 1, True))
    return out


def code_blocks(src: str, compat: bool = False) -> list[Unit]:
    """Blocks whose code, without comments and blanks, has at least 20 bytes."""
    lines, out = split_lines(src), []
    for b in blocks_of(lines):
        if not b.body:
            continue
        lang = language_of(lines[b.first].text)
        mark = COMMENT.get(lang)
        plain = "\n".join(squeeze(t) for x in b.body if (t := trim(x.text)) and not (mark and t.startswith(mark)))
        if size(plain) < 20 or (not compat and plain == DUPLICATE.strip()):
            continue
        start, end = b.body[0].start, b.body[-1].end
        shape = _key(f"code:{lang}\0{code_shape(plain, lang)}") if size(plain) >= 80 else ""
        out.append(Unit(start, end, size(src[start:end]), _key(f"{lang}\n{plain}"), shape, b.first + 1, True))
    return out
