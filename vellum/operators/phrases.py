"""Phrases that recur, and their short names.

An eligible phrase has 3 to 6 words of at least 3 ASCII letters each on one prose line, at least 15 bytes,
and none of Markdown's signs.  Words are separated by blanks; inline code ends a run of words (in compat
mode it doesn't, and a replaced phrase then swallows the code in its middle).
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from typing import NamedTuple

from vellum.operators.lines import Context, Edit, Line, rx, size, split_lines

SHORTEST, LONGEST, LEAST, LEAST_BYTES, MOST_NAMES = 3, 6, 5, 15, 64
_SIGNS = rx(r"[#()*<>\[\]_`{|}~]")
_THREE = rx("(?:[^A-Za-z]*[A-Za-z]){3}")


class Word(NamedTuple):
    start: int
    end: int
    text: str
    good: bool


def prose_line(text: str) -> bool:
    t = text.lstrip(" \t")
    if not t or t[0] in "#>|" or t[:2] in ("- ", "* ", "+ ") or t.startswith(("http://", "https://")):
        return False
    return not rx(r"\d+\. ").match(t)


def runs(lines: list[Line], compat: bool = False) -> list[list[Word]]:
    out = []
    for line in lines:
        if line.fenced or not prose_line(line.text):
            continue
        run: list[Word] = []
        at = line.start
        for i, part in enumerate(line.text.split("`")):
            if i % 2 == 0:
                run += [
                    Word(at + m.start(), at + m.end(), w := m.group(), bool(_THREE.match(w)) and not _SIGNS.search(w))
                    for m in rx("[^ \t\n]+").finditer(part)
                ]
            if not compat:
                out.append(run)
                run = []
            at += len(part) + 1
        out.append(run)
    return [r for r in out if len(r) >= SHORTEST]


_GOOD: dict[str, bool] = {}


def _good(word: str) -> bool:
    """Whether a word may be in a phrase; words are looked at once."""
    known = _GOOD.get(word)
    if known is None:
        if len(_GOOD) > 300_000:
            _GOOD.clear()
        known = _GOOD[word] = bool(_THREE.match(word)) and not _SIGNS.search(word)
    return known


def segments(lines: list[Line], compat: bool = False):
    """Runs of neighbouring words that may all be in a phrase, without their places."""
    for line in lines:
        if line.fenced or not prose_line(line.text):
            continue
        parts = line.text.replace("\t", " ").split("`")[::2]
        for part in [" ".join(parts)] if compat else parts:
            run: list[str] = []
            for w in part.split(" "):
                if not w:
                    continue
                if _good(w):
                    run.append(w)
                else:
                    if len(run) >= SHORTEST:
                        yield run
                    run = []
            if len(run) >= SHORTEST:
                yield run


class _Claims:
    """Ranges already taken, kept sorted and apart."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def factor(src: str, ctx: Context) -> list[Edit]:
    """With a corpus glossary its phrases are named, longest first; else the document's own."""
    lines = split_lines(src)
    if ctx.glossary or ctx.glossary_line:
        return _apply(runs(_named(lines, ctx), ctx.compat), ctx)
    if not _may_recur(lines, ctx.compat):
        return []
    found = runs(lines, ctx.compat)
    places = _frequent(found)
    ranked = sorted((-len(at) * (size(t) - 2), t.encode(), t) for t, at in places.items() if len(at) >= LEAST)
    claims, out, names = _Claims(), [], []
    for _, _, t in ranked:
        if len(names) == MOST_NAMES:
            break
        keep = [p for p in places[t] if claims.free(*p)]
        if len(keep) < LEAST:
            continue
        # Occurrences of one phrase may overlap each other: the earlier one stands.
        name = f"T{len(names) + 1}"
        for s, e in keep:
            if claims.free(s, e):
                claims.add(s, e)
                out.append(Edit(s, e, name))
        names.append(f"{name}={t}")
    return [Edit(0, 0, "[gloss] " + "; ".join(names) + "\n"), *out] if names else []


def _may_recur(lines: list[Line], compat: bool) -> bool:
    """Whether any three neighbouring words occur often enough, eligible or not; cheap, and true of few texts."""
    threes: Counter = Counter()
    for line in lines:
        if not line.fenced and prose_line(line.text):
            parts = line.text.replace("\t", " ").replace("\n", " ").split("`")[::2]
            for part in [" ".join(parts)] if compat else parts:
                w = [x for x in part.split(" ") if x]
                threes.update(zip(w, w[1:], w[2:]))
    return any(n >= LEAST for n in threes.values())


def _frequent(found: list[list[Word]]) -> dict[str, list[tuple[int, int]]]:
    """Places of the phrases that may recur often enough: every three neighbours in one must."""
    segments = []
    for run in found:
        i = 0
        while i < len(run):
            k = i
            while k < len(run) and run[k].good:
                k += 1
            if k - i >= SHORTEST:
                segments.append(run[i:k])
            i = k + 1
    threes = Counter(t for s in segments for t in zip(*([w.text for w in s[j:]] for j in range(3))))
    threes = {t for t, n in threes.items() if n >= LEAST}
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    if not threes:
        return places
    for s in segments:
        w = [x.text for x in s]
        hot = [t in threes for t in zip(w, w[1:], w[2:])]
        for a in range(len(hot)):
            n = 0
            while n <= LONGEST - SHORTEST and a + n < len(hot) and hot[a + n]:
                text = " ".join(w[a:a + n + SHORTEST])
                if size(text) >= LEAST_BYTES:
                    places[text].append((s[a].start, s[a + n + SHORTEST - 1].end))
                n += 1
    return places


def _named(lines: list[Line], ctx: Context) -> list[Line]:
    """The lines that may have a phrase of the glossary, by its first words."""
    first = {tuple(p.split(" ")[:SHORTEST]) for p in ctx.glossary}
    out = []
    for line in lines:
        parts = line.text.replace("\t", " ").replace("\n", " ").split("`")[::2]
        for part in [" ".join(parts)] if ctx.compat else parts:
            w = [x for x in part.split(" ") if x]
            if not first.isdisjoint(zip(w, w[1:], w[2:])):
                out.append(line)
                break
    return out


def _apply(found: list[list[Word]], ctx: Context) -> list[Edit]:
    claims, out = _Claims(), []
    for run in found:
        for n in range(LONGEST, SHORTEST - 1, -1):
            for a in range(len(run) - n + 1):
                name = ctx.glossary.get(" ".join(w.text for w in run[a:a + n]))
                s, e = run[a].start, run[a + n - 1].end
                if name and claims.free(s, e):
                    claims.add(s, e)
                    out.append(Edit(s, e, name))
    return [Edit(0, 0, ctx.glossary_line), *out] if ctx.glossary_line else out
