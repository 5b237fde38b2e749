"""Rules that look at lines, sections and sentences."""

from __future__ import annotations

import re

from vellum.operators.lines import (
    LABEL, TARGET, Context, Edit, Line, apply_edits, count_words, heading, in_code, rx, rxi, size, split_lines, squeeze, trim, whole, words,
)

## whole lines


def drop_lines(src: str, test, skip: str = "") -> list[Edit]:
    """Deletes unfenced lines whose trimmed text passes; blank lines and those starting with a sign of
    ``skip`` stay."""
    out = []
    for line in split_lines(src):
        t = trim(line.text)
        if t and not line.fenced and t[0] not in skip and test(t):
            out.append(whole(line))
    return out


_META = "|".join("""author available~s*(?:from|in|since) added~s*(?:since|in) compatible contributors? created date
deprecated~s*(?:in|since) last~s*updated minimum~s*(?:version)? modified published removed~s*(?:since|in) repo repository requires
since status support(?:ed|s)?~s*(?:by|on|with)? target(?:ing|s) tested~s*(?:with|on) toolchain updated version""".split())
META = rf"[*]{{0,2}}(?:{_META})"


def metadata_lines(src: str, ctx: Context) -> list[Edit]:
    def test(t: str) -> bool:
        low = t.lower()
        if ":" not in t or any(x in low for x in ("license", "copyright", "all rights reserved", "spdx")):
            return False
        return bool(rxi(META).match(t))

    return drop_lines(src, test, "|>#")


RULE_LINE = r"(?:-{3,}|[*]{3,}|_{3,})$"


def horizontal_rules(src: str, ctx: Context) -> list[Edit]:
    lines, out = split_lines(src), []
    for i, line in enumerate(lines):
        t = trim(line.text)
        if not t or line.fenced or not rx(RULE_LINE).match(t):
            continue
        if i == 0:
            if len(lines) > 1 and not trim(lines[1].text):
                continue
        else:
            before = trim(lines[i - 1].text)
            if before and not before.strip("-= "):
                continue
        out.append(whole(line))
    return out


def mkdocs_includes(src: str, ctx: Context) -> list[Edit]:
    starts = ("--8<--", ";--8<--", "--snippet--")
    return drop_lines(src, lambda t: t.startswith(starts) or t.startswith("{!"))


FOOTER = r"(?:[*]+~s*|#{1,6}~s+)?(?:view source|(?:page last modified|(?:page )?last updated)|edit on github|edit (?:this )?page)\b"


def edit_page_footers(src: str, ctx: Context) -> list[Edit]:
    return drop_lines(src, lambda t: rxi(FOOTER).match(t))


_FACT = "deprecated|since|nullable|optional|type|required|default"
TRIVIA = rf"[-*]~s+[*]{{0,2}}(?:{_FACT})[*]{{0,2}}~s*[=:]~s*(?:-|n/a|no|yes|false|true|nil|null|none)~s*[.]?$"


def api_parameter_trivia(src: str, ctx: Context) -> list[Edit]:
    return drop_lines(src, lambda t: rxi(TRIVIA).match(t))


_IS = "(?:is|looks like|should be|will be)"
VERIFY = "|".join(
    (
        rf"the (?:expected )?output {_IS}~s*:?$",
        rf"if (?:successful|valid),?~s+the output {_IS}~s*:?$",
        r"if the (?:command|check|test) (?:passes|fails|succeeds),?~s",
        r"if (?:it does|you do) not (?:get|see|encounter) (?:an |a )?error,?~s+it means~s",
        r"if (?:no )?errors? occurs?,?~s",
        r"you (?:will|should) (?:get|see)~s",
        r"if (?:all|everything) (?:went|goes|is) (?:correctly|well),?~s",
        r"if (?:the )?above (?:step|command)s? (?:succeeds|ran? without errors?|(?:completed?|executed?) successfully),?~s",
    )
)


def verification_boilerplate(src: str, ctx: Context) -> list[Edit]:
    return drop_lines(src, lambda t: rxi(VERIFY).match(t), "|>#")


SEO = "|".join(
    rf"(?:{x})$"
    for x in (
        "(?:on this page|in this (?:article|tutorial|section|document|guide)|help us improve|share this|rate this|feedback)~s*:?",
        r"(?:edit (?:on github|this page)(?: on github)?|suggest (?:changes|edits)|report a bug|found a typo\??)~s*:?",
        r"was this (?:document |article |page )?(?:useful|helpful)\??",
        "(?:page |last )?(?:reviewed|modified|updated)(?::| on ).*",
        "all content on this page .+(?:creative commons|copyright|license).+",
        r"\[?edit\]?(?:~s*on~s+github)?",
    )
)
_CRUMB = rf"(?:{LABEL}(?:{TARGET})?|[-._0-9a-z]+)"
CRUMBS = rf"{_CRUMB}~s*>~s*{_CRUMB}~s*>~s*.+$|\[?(?:cookbook|examples?|api|reference|guide|docs|home)\]?~s*[|>/]~s*\[?.+~s*[|>/]~s*.+$"
_PART = "(?:guide|article|chapter|page|section)?"
NEXT = (
    rf"(?:continue|back|next|prev|previous)~s*:?~s*{_PART}~s*[|:]?~s*(?:\[?[^\]]+\]?)?~s*$"
    rf"|\[?(?:back|next|prev|previous)~s*{_PART}~s*\]?~s*[|:]?~s*\[?[^\]]+\]?~s*$"
)


def seo_chaff(src: str, ctx: Context) -> list[Edit]:
    def test(t: str) -> bool:
        if rxi(SEO).match(t):
            return True
        n = count_words(t)
        return (n <= 12 and bool(rxi(CRUMBS).match(t))) or (n <= 10 and bool(rxi(NEXT).match(t)))

    return drop_lines(src, test, "|#>")


def blank_lines(src: str, ctx: Context) -> list[Edit]:
    lines, out = split_lines(src), []
    run, seen = 0, False
    for line in lines:
        if line.fenced or trim(line.text):
            run, seen = 0, True
            continue
        run += 1
        if not seen or run > 1:
            out.append(whole(line))
    for line in reversed(lines):
        if trim(line.text):
            break
        out.append(whole(line))
    return out


## inside lines

#: One character to one, or to none.
UNICODE = {
    **dict.fromkeys("“”„‟«»", '"'), **dict.fromkeys("‘’‚‛‹›", "'"), **dict.fromkeys("–‒−", "-"), **dict.fromkeys("•‣◦⁃", "*"),
    **dict.fromkeys("\xa0             　", " "),
    **dict.fromkeys("\xad​‌‍﻿", ""), "—": "--", "―": "--", "…": "...",
}
_UNICODE = str.maketrans(UNICODE)


def normalize_unicode(src: str, ctx: Context) -> list[Edit]:
    if src.isascii():
        return []
    out = []
    for line in split_lines(src):
        if line.fenced or line.text.isascii():
            continue
        parts = line.text.split("`")
        new = "`".join(p if i % 2 else p.translate(_UNICODE) for i, p in enumerate(parts))
        if new != line.text:
            out.append(Edit(line.start, line.start + len(line.text), new))
    return out


URL = r"https?://[^~S)>\]]+"
TRACKERS = r"[?&](?:utm_[a-z_]+|(?:fb|g)clid|[gw]braid|yclid|msclkid|mc_[ce]id|igshid|_g[al]|ref(?:_src)?|si)=[^&#~S)>\]]*"


def clean_url(url: str) -> str:
    """Without tracking parameters; what is left is made a proper query again."""
    new = rx(TRACKERS).sub("", url)
    if new == url:
        return url
    head, sep, query = new.partition("?")
    if not sep:
        head, sep, query = new.partition("&")
        query = re.sub("&+", "&", query) if sep else ""
    else:
        # An ampersand before the question mark comes first, and becomes the question mark.
        early, amp, late = head.partition("&")
        if amp:
            head, query = early, re.sub("&+", "&", (late + query).replace("?", ""))
        else:
            query = re.sub("&+", "&", query.lstrip("&").replace("?", ""))
    return (head + "?" + query if sep else head).rstrip("?&")


def url_tracking(src: str, ctx: Context) -> list[Edit]:
    out = []
    for line in split_lines(src):
        if line.fenced or "://" not in line.text:
            continue
        for m in rx(URL).finditer(line.text):
            new = clean_url(m.group())
            if len(new) < len(m.group()):
                out.append(Edit(line.start + m.start(), line.start + m.end(), new))
    return out


#: A phrase and what it becomes.  Phrases without one are deleted with the space after them.
_SWAPS = {
    "at this point in time": "now", "a number of": "several", "due to the fact that": "because", "for the purpose of": "for",
    "in order to": "to", "in the event that": "if", "with regard to": "about",
}
_WE = r"in this (?:tutorial|guide|chapter|section),? we'll?"
_GONE = "\n".join(
    (
        "as a general rule of thumb,?", "as a matter of fact,?", "as you can see,?", "at the end of the day,?", "bear in mind that", "do not forget to",
        "first of all,?", "for what it's worth,?", "if you will,?", "interestingly enough,?", "it goes without saying that",
        "it is important to (?:note|understand) that", "it is worth noting(?: that)?", "it should be (?:mentioned|noted) that",
        "it (?:goes without saying that it is |is )(?:also )?(?:interesting to |worth )?(?:pointing out|mentioning|noting) that", "keep (?:it )?in mind that",
        "let's (?:examine|explore|dive into|(?:have|take) a look at)", "make sure to", "needless to say,?", "now,?~s+what's (?:truly |really )?interesting is",
        "please note(?: that)?", "so to speak,?", "that said,?", "the bottom line is,?", "(?:that |this )?being said,?",
        "to (?:make a long story|put) (?:things |it )?(?:short|simply),?", "without further ado,?", "you might be wondering,?",
    )
).split("\n")
#: For each pattern a word that any match of it holds, to tell cheaply which patterns a text needs.
_SURE = {
    "let's (?:examine": "let's", "it (?:goes without": "that", "it is important": "important to", "it is worth": "worth noting", "it should": "it should be",
    "now,?": "interesting is", "(?:that |this )?being": "being said", "to (?:make": "to ", "keep (?:it": "in mind that",
}


def _sure(pattern: str) -> str:
    known = next((w for head, w in _SURE.items() if pattern.startswith(head)), None)
    return known or re.split(r"[,(?~]", pattern)[0].strip()


HEDGES = [(rf"\b{p}~s+", "", _sure(p)) for p in _GONE] + [(rf"\b{p}\b", r, p) for p, r in _SWAPS.items()] + [(rf"\b{_WE}~s+", "we'll ", "we'l")]


def hedging_phrases(src: str, ctx: Context) -> list[Edit]:
    low = src.lower()
    needed = [h for h in HEDGES if h[2] in low]
    if not needed:
        return []
    out = []
    for line in split_lines(src):
        t = trim(line.text)
        if line.fenced or not t or t[0] == "|":
            continue
        text, low = line.text, line.text.lower()
        found = []
        for pattern, new, sure in needed:
            if sure not in low:
                continue
            for m in rxi(pattern).finditer(text):
                if not in_code(text, m.start()):
                    found.append((m.start(), -m.end(), new))
        until = -1
        for start, end, new in sorted(found):
            end = -end
            if start < until:
                continue
            before = trim(text[:start])
            opens = not before or before[-1] in ".!?"
            if opens and new:
                new = new[0].upper() + new[1:]
            elif opens and end < len(text) and text[end].islower():
                new = text[end].upper()
                end += 1
            out.append(Edit(line.start + start, line.start + end, new))
            until = end
    return out


_ICONS = "".join(map(chr, (0x26A0, 0xFE0F, 0x2705, 0x274C, 0x26A1, *range(0x1F4A0, 0x1F4AD), 0x1F4A5, 0x1F4D6, 0x1F4E2, 0x1F4E3, 0x1F50D, 0x1F525, 0x1F527, 0x1F6A7, 0x1F6A8, 0x1F389, 0x1F916)))
_NOTES = "REMINDER|HINT|DANGER|CAUTION|INFO|TIP|IMPORTANT|WARNING|NOTE"
_STRESS = r"(?:[*]{1,2}|_{1,2})"


def admonition_prefixes(src: str, ctx: Context) -> list[Edit]:
    pattern = rxi(rf"{_STRESS}~s*(?:[{_ICONS}]*~s*)?(?:{_NOTES})(?![A-Za-z0-9])~s*:?~s*{_STRESS}?~s*:?~s*")
    out = []
    for line in split_lines(src):
        t = trim(line.text)
        if line.fenced or not t or t[0] == "|":
            continue
        lead = len(line.text) - len(line.text.lstrip())
        quote = re.match("[> ]*", line.text[lead:]).end()
        m = pattern.match(line.text, lead + quote)
        if m:
            out.append(Edit(line.start + lead + quote, line.start + m.end()))
    return out


_LINK = r"\[[^\]]+\]\(?[^)]*\)?"
_MORE = "(?: for (?:(?:further |more )?(?:details|information{0})))?"
CROSS = [
    rf"see the {_LINK}~s*(?:above|below|manual|reference|tutorial|chapter|doc(?:ument)?|page|guide|section)?[.;]?",
    rf"for more (?:info(?:rmation)?|details),? see (?:the )?{_LINK}[.;]?",
    rf"refer to (?:the )?{_LINK}{_MORE.format('|guidelines?')}[.;]?",
    rf"check out (?:the )?{_LINK}{_MORE.format('')}[.;]?",
    rf"read (?:further |more )?(?:about it )?in (?:the )?{_LINK}[.;]?",
    rf"see also~s*:?~s*{_LINK}[.;]?",
    rf"(?:kindly |please )?(?:consult|check|see|refer) {_LINK}{_MORE.format('|guidance')}~s*[.;]?",
    rf"(?:navigate|go|head) (?:back |over )?to (?:the )?{_LINK}~s*(?:guide|doc|page|section)?[.;]?",
    rf"more (?:information|details) (?:are available|can be found) (?:at|in) {_LINK}[.;]?",
    rf"(?:feel free to |please )?(?:check|visit) (?:out )?{_LINK}{_MORE.format('')}[.;]?",
    rf"(?:keep |continue )?reading (?:at|in) {_LINK}[.;]?",
]
_CROSS_WORDS = ("check", "head", "more detail", "more information", "navigate", "read", "refer", "see", "visit")


def cross_references(src: str, ctx: Context) -> list[Edit]:
    out = []
    for line in split_lines(src):
        t = trim(line.text)
        if line.fenced or not t or t[0] in "|>" or "[" not in t:
            continue
        low = t.lower()
        if not any(w in low for w in _CROSS_WORDS):
            continue
        for pattern in CROSS:
            for m in rxi(pattern).finditer(line.text):
                head = line.text[:m.start()].rstrip(" ")
                if head.endswith(","):
                    head = head[:-1].rstrip(" ")
                out.append(Edit(line.start + len(head), line.start + m.end()))
    return out


## changelogs

_MONTHS = "January February March April May June July August September October November December Sept"
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in _MONTHS.split()) + ")"
_ISO = r"\d{4}[/-]\d{1,2}[/-]\d{1,2}"
_REF = rf"\[#[0-9]+\]{TARGET}"
_AT = r"@[-\w]+"
_WHO = r"\[\w[-.\w]*\][(]https?://github[.]com/[-\w]+/?[)]"
IDS = [
    rf"~s*\({_AT}(?:~s+(?:in~s+)?{_REF})+(?:~s*,~s*{_REF})*\)",
    rf"~s*\({_WHO}(?:~s*[,&]~s*{_WHO})*(?:~s+in~s+{_REF})?\)",
    rf"~s*\({_REF}(?:~s*,~s*{_REF})*\)",
    rf"~s*\((?:(?:h/t|by|thanks(?:~s+to)?)~s+)?{_AT}(?:~s*,~s*{_AT})*\)",
    r"~s+\[#[0-9]+\][(]https?://[^)]+/(?:compare|commit|issues|pull)/[^)]+[)]~s*$",
]
DATES = [rf"~s*\(~s*{_MONTH}[^)]*\d{{4}}~s*\)~s*$", rf"~s*[—–-]~s*{_ISO}~s*$", rf"~s*\(~s*{_ISO}~s*\)~s*$"]
CHANGELOG_PATH = r"(?:^|/)(?:history|releases|release[_-]?notes|change[_-]?log)(?:[-.]|$)"


def is_changelog(lines: list[Line], path: str) -> bool:
    if path and rxi(CHANGELOG_PATH).search(path):
        return True
    for line in lines[:21]:
        t = trim(line.text)
        if line.fenced or not t:
            continue
        if rxi(r"#+~s*(?:what'?s new|version history|history|releases|release notes|change ?log)~s*$").match(t):
            return True
        if t[0] == "#":
            return False
    return False


def changelogs(src: str, ctx: Context) -> list[Edit]:
    lines = split_lines(src)
    if not is_changelog(lines, ctx.path):
        return []
    out = []
    for line in lines:
        t = trim(line.text)
        if line.fenced or not t:
            continue
        if rxi(r"#+~s*(?:\[?v?\d+\.\d+|next|upcoming|unreleased)\b").match(t):
            m = next((m for p in DATES if (m := rx(p).search(line.text))), None)
            if m:
                out.append(Edit(line.start + m.start(), line.start + m.end()))
        elif rx(rf"{_MONTH}~s+\d{{1,2}}(?:th|rd|nd|st)?,?~s+\d{{4}}~s*$").match(t):
            out.append(whole(line))
        else:
            out += [Edit(line.start + m.start(), line.start + m.end()) for p in IDS for m in rx(p).finditer(line.text)]
    return out


## document and sections


def frontmatter(src: str, ctx: Context) -> list[Edit]:
    m = re.match(r"(---|\+\+\+)\r?\n", src)
    at = src.find(m.group(1), 3) if m else -1
    if at < 0:
        return []
    end = at + 3
    end += src.startswith("\r", end)
    end += src.startswith("\n", end)
    return [Edit(0, end)]


def setext_headers(src: str, ctx: Context) -> list[Edit]:
    """In compat mode the line after the heading is glued to it, as the underline's newline goes too."""
    lines, out = split_lines(src), []
    for a, b in zip(lines, lines[1:]):
        title, under = trim(a.text), b.text.rstrip(" \t\r\n")
        if a.fenced or b.fenced or not title or title[0] in "#|>" or not under or set(under) not in ({"="}, {"-"}):
            continue
        mark = "# " if under[0] == "=" else "## "
        end = b.end if ctx.compat else b.start + len(b.text)
        out.append(Edit(a.start, end, mark + title))
    return out


_TITLE = r"~s{0,3}(#{1,6})~s+(.+?)~s*#*~s*$"
_ITEM = r"~s*(?:[-+*]|\d+\.)~s+"
_ANCHOR = LABEL + "[(]#[^)]+[)]"


def _title(text: str) -> tuple[int, str] | None:
    m = rx(_TITLE).match(text)
    return (len(m.group(1)), trim(m.group(2))) if m else None


def toc(src: str, ctx: Context) -> list[Edit]:
    lines, out, skip = split_lines(src), [], -1
    for i, line in enumerate(lines):
        if i <= skip or line.fenced:
            continue
        t = _title(line.text)
        if not t or t[1].lower() not in ("toc", "contents", "table of content", "table of contents"):
            continue
        items = anchors = 0
        end = i + 1
        while end < len(lines):
            text = lines[end].text
            if trim(text):
                if not rx(_ITEM).match(text):
                    break
                items += 1
                anchors += bool(rx(_ANCHOR).search(text))
            end += 1
        if items and anchors >= 0.7 * items:
            out.append(Edit(line.start, lines[end - 1].end))
            skip = end - 1
    return out


_CTA = "|".join(
    ("star(?: this(?: repo)?)?", "(?:please )?star us", "follow(?: us| me)?(?: on .+)?", "sponsor(?: this project)?", "(?:buy me a )?coffee",
     "support(?: this project| us| me)?", "connect with(?: us| me)", "social(?: media)?")
)


def trailing_cta(src: str, ctx: Context) -> list[Edit]:
    lines, out = split_lines(src), []
    after = int(size(src) * 0.7)
    at, skip = 0, -1
    for i, line in enumerate(lines):
        here, at = at, at + size(line.text) + 1
        t = _title(line.text) if i > skip and "#" in line.text else None
        if not t or t[0] > 2 or here < after or (line.fenced and not ctx.compat):
            continue
        end = i
        for k in range(i + 1, len(lines)):
            nxt = _title(lines[k].text) if "#" in lines[k].text and (ctx.compat or not lines[k].fenced) else None
            if nxt and nxt[0] <= t[0]:
                break
            end = k
        name, body = t[1].lower(), "\n".join(x.text for x in lines[i + 1:end + 1])
        gone = bool(rx(f"(?:{_CTA})$").match(name))
        gone = gone or (bool(rx("about(?: us| the author)?$").match(name)) and count_words(body) < 50)
        gone = gone or (name == "license" and count_words(body) < 30 and "apache license" not in body.lower())
        if gone:
            out.append(Edit(line.start, lines[end].end))
            skip = end
    return out


_BOILER = "(?:acknowledgements?|authors?|backers?|code of conduct|community|contributing|copyright and license|credits|getting help|license|maintainers?|need help\\??|questions\\??|sponsors?|support|thanks)"


def _short(body: str, name: str) -> bool:
    low, name = body.lower(), name.lower()
    has = lambda *xs: any(x in low for x in xs)
    if "contribut" in name:
        return has("contributing.md") or (has("contribute") and has("read", "please", "welcome"))
    if "license" in name:
        return has("license") and has("apache", "bsd", "gpl", "mit", "mpl", "see")
    if any(x in name for x in ("question", "help", "support")):
        return has("discord", "discussion", "file a", "forum", "issue", "join our", "reach out", "slack", "stack overflow")
    if "code of conduct" in name:
        return has("code-of-conduct", "code_of_conduct.md", "covenant", "enforcement")
    return count_words(body) <= 60


def boilerplate_sections(src: str, ctx: Context) -> list[Edit]:
    lines, out = split_lines(src), []
    level_of = lambda x: len(x.text) - len(x.text.lstrip("#"))
    for i, line in enumerate(lines):
        h = None if line.fenced else heading(trim(line.text))
        if not h or not rxi(f"{_BOILER}~s*$").match(h[1]):
            continue
        end = None
        for nxt in lines[i + 1:]:
            if not nxt.fenced and heading(trim(nxt.text)) and level_of(nxt) <= level_of(line):
                end = nxt.start
                break
        if end is None:
            end = len(lines) if ctx.compat else len(src)
        if end > line.start and _short(src[line.start:end], h[1]):
            out.append(Edit(line.start, end))
    return out


## intro sentences said again in the body

_ALNUM = "A-Za-z0-9"
_TOKEN = rf"[{_ALNUM}][-./_{_ALNUM}]*"
_STOP = frozenset("a an and are as at be by for from in into is it of on or that the this to with".split())


def is_prose(t: str) -> bool:
    return bool(t) and t[0] not in "#|>" and t[:2] not in ("- ", "* ", "+ ")


def tokens(s: str) -> set[str]:
    return {t for t in (x.strip("._/-") for x in rx(_TOKEN).findall(s.lower())) if t and t not in _STOP}


def sentences(s: str, base: int = 0) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for m in re.finditer(r"[.!?](?=\s|$)|\Z", s):
        piece = s[at:m.end()]
        text = trim(piece)
        if text:
            start = at + len(piece) - len(piece.lstrip())
            out.append((base + start, base + start + len(text), text))
        at = m.end()
    return out


def _kept_names(intro: str, body: str) -> bool:
    low = body.lower()
    for t in rx(_TOKEN).findall(intro):
        t = t.strip("._/-")
        if t and (rx("[0-9./_-]").search(t) or t[0].isupper()) and t.lower() not in low:
            return False
    return True


def cross_section(src: str, ctx: Context) -> list[Edit]:
    if size(src) > 256 * 1024:
        return []
    lines = split_lines(src)
    intro, body, headings, i = [], [], 0, 0
    while i < len(lines):
        t = trim(lines[i].text)
        if lines[i].fenced or not t or heading(t) or not is_prose(t):
            headings += bool(t and not lines[i].fenced and heading(t))
            i += 1
            continue
        start = i
        i += 1
        while i < len(lines) and not lines[i].fenced and is_prose(trim(lines[i].text)) and "|" not in lines[i].text:
            i += 1
        found = sentences(src[lines[start].start:lines[i - 1].end], lines[start].start)
        (intro if headings < 2 else body).extend((s, tokens(s[2]), count_words(s[2])) for s in found)
    if len(intro) * len(body) > 250_000:
        return []
    out = []
    for (start, end, text), toks, n in intro:
        if not 6 <= n <= 45 or "](" in text or len(toks) < 5:
            continue
        for (_, _, other), more, m in body:
            if m >= n + 3 and len(more) > len(toks) and len(toks & more) >= 0.85 * len(toks) and _kept_names(text, other):
                while end < len(src) and src[end] in " \t":
                    end += 1
                while start and src[start - 1] in " \t":
                    start -= 1
                out.append(Edit(start, end))
                break
    return out
