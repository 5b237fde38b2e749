"""Rules for images, badges, comments and HTML wrappers."""

from __future__ import annotations

import re

from vellum.operators.lines import TARGET, Context, Edit, count_words, rx, rxi, split_lines, squeeze, trim, whole

_ALT = r"!\[([^\]]*)\]"
_SRC = r"\(([^)~S]+)(?:~s+\"[^\"]*\")?\)"
_PIC = rf"{_ALT}{_SRC}"
_PIC_REF = rf"{_ALT}\[([^\]]+)\]"
INLINE = (rf"\[{_PIC}\]\([^)]+\)", _PIC)
BY_REF = (rf"\[{_PIC_REF}\]\[[^\]]+\]", _PIC_REF)
DEFINITION = r"~s*\[([^\]]+)\]:~s*(\S+)"
_DOT = "(?is)"
_IMG = r"<img\b[^>]*\bsrc=[\"']([^\"']+)[\"'][^>]*>"
_A_IMG = rf"<a\b[^>]*>~s*{_IMG}~s*</a>"
_P_BADGES = rf"<p\b[^>]*>~s*(?:{_A_IMG}~s*)+</p>"

#: Parts of the addresses of services that serve badges, alphabetically.
HOSTS = tuple(
    """/actions/workflows/ api.cirrus-ci.com api.scorecard.dev/projects/ app.buddy.works app.codacy.com/project/badge app.fossa.com app.saucelabs.com
    app.wercker.com badge.fury.io badge.svg bestpractices.coreinfrastructure.org/projects/ bettercodehub.com camo.githubusercontent.com ci.appveyor.com
    circleci.com/gh/ codecov.io coverage-badge. coveralls.io david-dm.org drone.io goreportcard.com/badge/ inch-ci.org lgtm.com pepy.tech requires.io
    semaphoreci.com shields.io snyk.io/test/ sonarcloud.io/api/project_badges travis-ci.com travis-ci.org""".split()
)
_BADGE_WORDS = ("badge", "build", "ci", "coverage", "download", "license", "status", "version")


def badge_url(url: str) -> bool:
    low = url.lower()
    return any(h in low for h in HOSTS)


def telling_alt(alt: str) -> bool:
    low = trim(alt).lower()
    return count_words(low) > 5 and not any(w in low for w in _BADGE_WORDS)


def _label(s: str) -> str:
    return squeeze(s).lower()


def badges(src: str, ctx: Context) -> list[Edit]:
    if "[" not in src and "<" not in src:
        return []
    lines = split_lines(src)
    fenced = [(x.start, x.end) for x in lines if x.fenced]
    out: list[Edit] = []

    def free(at: int) -> bool:
        return ctx.compat or not any(s <= at < e for s, e in fenced)

    block_spans = []
    if "<img" in src.lower():
        for m in rx(_DOT + _P_BADGES).finditer(src):
            if free(m.start()) and all(badge_url(u) for u in rx(_DOT + _IMG).findall(m.group())):
                block_spans.append((m.start(), m.end()))
        for m in rx(_DOT + _A_IMG).finditer(src):
            if free(m.start()) and badge_url(m.group(1)) and "\n" in m.group() and not any(s <= m.start() < e for s, e in block_spans):
                block_spans.append((m.start(), m.end()))
        out += [Edit(s, e) for s, e in block_spans]
    urls, used = {}, set()
    for line in lines:
        m = None if line.fenced else rx(DEFINITION).match(line.text)
        if m:
            urls[_label(m.group(1))] = m.group(2)
    for line in lines:
        text = line.text
        if line.fenced or ("!" not in text and "<" not in text):
            continue
        spans: list[tuple[int, int]] = []

        def take(m: re.Match) -> bool:
            if any(s <= m.start() and m.end() <= e for s, e in spans) or any(s <= line.start + m.start() < e for s, e in block_spans):
                return False
            spans.append(m.span())
            return True

        for pattern in INLINE:
            for m in rx(pattern).finditer(text):
                if badge_url(m.group(2)) and not telling_alt(m.group(1)):
                    take(m)
        for pattern in BY_REF:
            for m in rx(pattern).finditer(text):
                name = _label(m.group(2))
                if badge_url(urls.get(name, "")) and not telling_alt(m.group(1)) and take(m):
                    used.add(name)
        for pattern in (_A_IMG, _IMG):
            for m in rx(_DOT + pattern).finditer(text):
                if badge_url(m.group(1)):
                    take(m)
        if not spans:
            continue
        rest = list(text)
        for s, e in spans:
            rest[s:e] = " " * (e - s)
        if trim("".join(rest)):
            out += [Edit(line.start + s, line.start + e) for s, e in spans]
        else:
            out.append(whole(line))
    for line in lines:
        m = None if line.fenced else rx(DEFINITION).match(line.text)
        if m and (_label(m.group(1)) in used or badge_url(m.group(2))):
            out.append(whole(line))
    return out


_A, _PIC_TAG = (rf"<{t}\b[^>]*>" for t in ("a", "img"))
_TAG = rf"(?:{_A}~s*)?{_PIC_TAG}(?:~s*</a>)?"
_SHOWY = ("banner", "divider", "header", "hero", "image", "logo", "pic", "screenshot")


def decorative_alt(alt: str) -> bool:
    alt = trim(alt)
    if len(alt) < 2:
        return True
    return count_words(alt) <= 3 and any(w in alt.lower() for w in _SHOWY)


def _attribute(name: str, tag: str) -> str:
    m = rx(rf"(?is)\b{name}=[\"']([^\"']*)[\"']").search(tag)
    return m.group(1) if m else ""


def decorative_tag(tag: str) -> bool:
    src = _attribute("src", tag).lower()
    return decorative_alt(_attribute("alt", tag)) or any(w in src for w in _SHOWY[:4] + ("logo",))


def decorative_images(src: str, ctx: Context) -> list[Edit]:
    if "![" not in src and "<" not in src:
        return []
    lines, out = split_lines(src), []
    fenced = [(x.start, x.end) for x in lines if x.fenced]
    if "<img" in src.lower():
        for m in rx(rf"(?is)<p\b[^>]*>~s*{_TAG}~s*</p>").finditer(src):
            if decorative_tag(m.group()) and (ctx.compat or not any(s <= m.start() < e for s, e in fenced)):
                out.append(Edit(m.start(), m.end()))
    for line in lines:
        if line.fenced:
            continue
        m = rx(rf"~s*{_ALT}{TARGET}~s*$").match(line.text)
        if m and decorative_alt(m.group(1)):
            out.append(whole(line))
        elif "<" in line.text and rx(rf"(?is)~s*{_TAG}~s*$").match(line.text) and decorative_tag(line.text):
            out.append(whole(line))
    return out


def html_comments(src: str, ctx: Context) -> list[Edit]:
    if "<!--" not in src:
        return []
    out, done = [], 0
    for line in split_lines(src):
        if line.fenced or line.end <= done:
            continue
        at = max(line.start, done)
        while (start := src.find("<!--", at, line.end)) >= 0:
            close = src.find("-->", start + 4)
            if close < 0:
                break
            end = close + 3
            left = src.rfind("\n", 0, start) + 1
            cut = src.find("\n", end)
            right = len(src) if cut < 0 else cut + 1
            if trim(src[left:start]) or trim(src[end:right]):
                out.append(Edit(start, end))
            else:
                right += left > 0 and src.startswith("\n", right)
                out.append(Edit(left, right))
            at = done = end
            if end > line.end:
                # The comment closes on a later line, whose rest is left alone.
                done = right if cut >= 0 else len(src)
                break
    return out


_NAMES = "abbr|big|center|details|dfn|div|font|p|small|span|summary"


def html_wrappers(src: str, ctx: Context) -> list[Edit]:
    """An element with nothing in it goes, and outside compat mode so does nothing else; in compat mode lone
    closing tags go too, which can leave their opening tags behind."""
    if "<" not in src:
        return []
    lines, out, skip = split_lines(src), [], -1
    for i, line in enumerate(lines):
        t = trim(line.text)
        if i <= skip or line.fenced or not t.startswith("<"):
            continue
        if rx(rf"</(?:{_NAMES})>~s*$").match(t):
            if ctx.compat:
                out.append(whole(line))
            continue
        small = rxi("<small>").match(t)
        m = rx(rf"<({_NAMES})\b[^>]*>~s*$").match(t) or rxi(r"<(p)~s+align~s*=~s*\"[^\"]*\"~s*>~s*$").match(t)
        if m and not small:
            k = i + 1
            while k < len(lines) and (lines[k].fenced or not trim(lines[k].text)):
                k += 1
            if k < len(lines) and trim(lines[k].text).startswith(f"</{m.group(1)}>"):
                out += [whole(line), whole(lines[k])]
                skip = k
        elif small:
            for k in range(i + 1, min(len(lines), i + 7)):
                if rxi(r".*</small>~s*$").match(trim(lines[k].text)):
                    out.append(Edit(line.start, lines[k].end))
                    skip = k
                    break
    return out
