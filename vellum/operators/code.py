"""Rules for fenced code."""

from __future__ import annotations

from vellum.operators.lines import Block, Context, Edit, Line, blocks_of, cut_lines, language_of, rx, rxi, size, split_lines, squeeze, trim, words

_ALIASES = {
    "go": "golang", "python": "py py3", "js": "javascript typescript ts jsx tsx mjs cjs", "java": "scala kotlin", "c": "cpp c++ h hpp cxx cc",
    "rust": "rs", "ruby": "rb", "php": "", "swift": "", "proto": "protobuf",
}
FAMILY = {name: family for family, names in _ALIASES.items() for name in (family, *names.split())}
#: For each family, what starts a trimmed line that only brings in names.
IMPORTS = {
    "go": r'import~s+"[^"]*"$|package ',
    "python": r"import~s+\S|from~s+\S+~s+import|if~s+__name__~s*==~s*['\"]__main__['\"]~s*:|#!/usr/bin/(?:env~s+)?python",
    "js": r"(?:export|import)~s+|(?:let|var|const)~s+\w+~s*=~s*require\(|module\.exports~s*=",
    "java": r"(?:package|import)~s+\S",
    "c": r"#include~s*[\"<]|using~s+(?:static|namespace)~s+|#pragma~s",
    "rust": r"(?:use|mod)~s+\S|extern~s+crate~s+|#\[derive\(",
    "ruby": r"require(?:_relative)?~s+['\"]|(?:extend|include)~s+\S",
    "php": r"(?:namespace|use)~s+\S+~s*;?$|(?:include|require)(?:_once)?~s+",
    "swift": r"import~s+\S+$|@_exported",
    "proto": r'import~s+"[^"]*"',
}
SHELLS = frozenset("bash console fish ksh powershell pwsh sh shell terminal zsh".split())
_INI = frozenset("cfg conf editorconfig gitconfig ini properties".split())
_MAKE = frozenset(("makefile", "mk"))
_DOCKER = frozenset(("docker", "dockerfile"))
_CONFIG = _INI | _MAKE | _DOCKER | frozenset("env hcl terraform tf toml yaml yml".split())
_SLASH = frozenset("c c++ cpp cs dart go golang h hpp java javascript js jsx kotlin php rs rust scala swift ts tsx typescript".split())
_HASH = frozenset("bash perl pl py py3 python r rb ruby sh yaml yml zsh".split())
_DASH = frozenset("haskell hs lua sql".split())
#: Marks of line comments in the normal form that cross-document rules hash.
COMMENT = {k: "//" for k in (_SLASH | {"svelte", "vue"})} | {k: "#" for k in ("py", "python", "rb", "ruby")}
PROMPT = r"(?:\$~s*|>~s*|#~s+)(.*)"
DUPLICATE = "[duplicate — same as block above]\n"


def _prompts(code: list[str], lang: str) -> bool:
    shell = lang in SHELLS
    if not shell and sum(bool(rx(PROMPT).match(x)) for x in code[:10]) < 2:
        return False
    changed = False
    for i, x in enumerate(code):
        m = rx(PROMPT).match(x)
        if m:
            code[i], changed = m.group(1), True
        elif rx("#!/").match(x) or (lang and rx(r"set~s+[-+][a-zA-Z]|source~s+|\.~s+\S").match(x)):
            code[i], changed = "", True
    return changed


def _blank(code: list[str], test) -> bool:
    changed = False
    for i, x in enumerate(code):
        t = trim(x)
        if t and test(t):
            code[i], changed = "", True
    return changed


def _config(code: list[str], lang: str) -> bool:
    if lang not in _CONFIG:
        return False

    def test(t: str) -> bool:
        if t[0] == "#" or (lang in _INI and t[0] == ";"):
            return True
        if lang in _MAKE:
            return bool(rx("ifn?eq|ifn?def|else|endif").match(t))
        return lang in _DOCKER and bool(rx("(?:LABEL|MAINTAINER)~s+").match(t))

    return _blank(code, test)


def _imports(code: list[str], lang: str) -> bool:
    family = FAMILY.get(lang)
    if not family:
        return False
    state = {"open": False, "guard": False}

    def test(t: str) -> bool:
        if family == "go":
            if state["open"]:
                state["open"] = t != ")"
                return True
            if rx(r"import~s*\($").match(t):
                state["open"] = True
                return True
        if family == "c":
            if rx("#ifndef~s").match(t):
                state["guard"] = True
                return True
            if state["guard"] and rx("#define~s").match(t):
                return True
            if state["guard"] and t.startswith("#endif"):
                state["guard"] = False
                return True
        return bool(rx(IMPORTS[family]).match(t))

    changed = _blank(code, test)
    return changed


def _go_errors(code: list[str], lang: str) -> bool:
    if FAMILY.get(lang) != "go":
        return False
    changed, i = False, 0
    while i < len(code):
        if rx(r"if~s+err~s*!=~s*nil~s*\{?~s*$").match(trim(code[i])):
            code[i], changed = "", True
            if i + 1 < len(code) and rx(r"return~s+(?:nil,~s*)?\w*err\w*~s*$").match(trim(code[i + 1])):
                i += 1
                code[i] = ""
        i += 1
    return changed


def _comments(code: list[str], lang: str, compat: bool) -> bool:
    """Line and block comments.  Outside compat mode a block comment is one that starts its line, and
    a Python docstring ends where its quotes do."""
    closer = ""

    def test(t: str) -> bool:
        nonlocal closer
        if closer:
            if closer in t:
                closer = ""
            return True
        if lang in _SLASH:
            starts = "/*" in t if compat else t.startswith("/*")
            if starts:
                if "*/" not in t:
                    closer = "*/"
                elif not compat and not t.endswith("*/"):
                    return False
                return True
            if t.startswith("//"):
                return True
        if lang in _HASH and t[0] == "#":
            return True
        if lang in _DASH and rx("--~s").match(t):
            return True
        if lang in ("py", "py3", "python") and t[:3] in ('"""', "'''"):
            if compat:
                closer = "*/"
            elif t.count(t[:3]) == 1:
                closer = t[:3]
            return True
        return False

    return _blank(code, test)


def compress_code(src: str, ctx: Context) -> list[Edit]:
    lines = split_lines(src)
    out, seen = [], set()
    for b in blocks_of(lines):
        if not b.body:
            continue
        lang = language_of(lines[b.first].text)
        code = [x.text for x in b.body]
        key = "\n".join(code)
        start, end = b.body[0].start, b.body[-1].end
        if ctx.tier >= 2 and key in seen:
            out.append(Edit(start, end, DUPLICATE))
            continue
        changed = _prompts(code, lang)
        changed |= _config(code, lang)
        if ctx.tier >= 2:
            seen.add(key)
            changed |= _imports(code, lang)
            changed |= _go_errors(code, lang)
            changed |= _comments(code, lang, ctx.compat)
        if changed:
            left = [x for x in code if trim(x)]
            out.append(Edit(start, end, "\n".join(left) + "\n") if left else Edit(b.start, b.end))
    return out


def truncate_code(src: str, ctx: Context) -> list[Edit]:
    lines, out = split_lines(src), []
    for b in blocks_of(lines):
        if len(b.body) > ctx.max_lines:
            out += cut_lines(b.body, ctx.max_lines)
        elif b.body:
            start, end = b.body[0].start, b.body[-1].end
            raw = src[start:end].encode()
            if len(raw) > 2048:
                cut = raw.find(b"\n", 1024)
                if 0 <= cut < len(raw):
                    mark = f"[... {len(raw) - cut} more bytes ...]\n"
                    if len(mark) < len(raw) - cut:
                        out.append(Edit(start + len(raw[:cut].decode()), end, mark))
    return out


def middle_budget(src: str, ctx: Context) -> list[Edit]:
    lines = split_lines(src)
    n = len(lines)
    if n < 200:
        return []
    return [e for b in blocks_of(lines) if b.first >= n // 4 and b.last < n * 3 // 4 for e in cut_lines(b.body, 8)]


def _plain(body: list[Line], lang: str) -> list[str]:
    mark = COMMENT.get(lang)
    out = []
    for x in body:
        t = trim(x.text)
        if t and not (mark and t.startswith(mark)):
            t = trim(t.lower().strip(";{}"))
            if t:
                out.append(t)
    return out


def alike(a: list[str], b: list[str]) -> bool:
    if min(len(a), len(b)) < 2 or not 0.4 <= len(a) / len(b) <= 2.5:
        return False
    x, y = words("\n".join(a)), words("\n".join(b))
    return bool(x and y) and len(set(x) & set(y)) >= 0.5 * max(len(x), len(y))


def multilang(src: str, ctx: Context) -> list[Edit]:
    lines = split_lines(src)
    blocks = blocks_of(lines)
    langs = [language_of(lines[b.first].text) for b in blocks]
    out = []
    for a, b, la, lb in zip(blocks, blocks[1:], langs, langs[1:]):
        if la and lb and la != lb and a.body and len(b.body) > 1 and alike(_plain(a.body, la), _plain(b.body, lb)):
            out.append(Edit(b.body[0].start, b.body[-1].end, f"[equivalent to {la} example above]\n"))
    return out


COMMAND = r"(?:-h|--help|--version)(?:~s*[`'\"’”)]*)?~s*[.:]?$"
_WORD = "[A-Za-z0-9][-A-Za-z0-9]*"
FLAG = rf"(?:{_WORD},~s*--{_WORD}|-{{1,2}}{_WORD})(?:,|~s|$)"
USAGE = "(?:available commands|commands|flags|options|usage):~s*"


def _command_before(lines: list[Line], at: int) -> str:
    i = at - 1
    while i >= 0 and not trim(lines[i].text):
        i -= 1
    if i < 0:
        return ""
    t = trim(lines[i].text)
    if rxi(COMMAND).search(t):
        return t
    if lines[i].fenced:
        # The block before: its last line of code.
        for k in range(i, -1, -1):
            t = trim(lines[k].text)
            if not lines[k].fenced:
                break
            if t and t[:3] not in ("```", "~~~"):
                return t if rxi(COMMAND).search(t) else ""
    return ""


def example_output(src: str, ctx: Context) -> list[Edit]:
    lines, out = split_lines(src), []
    for b in blocks_of(lines):
        command = _command_before(lines, b.first)
        code = [t for x in b.body if (t := trim(x.text))]
        if not command or not code or len(code) > 50:
            continue
        flags = sum(bool(rx(FLAG).match(t)) for t in code)
        if "--version" in command.lower():
            gone = len(code) <= 3
        else:
            gone = (flags > 0 and any(rxi(USAGE).match(t) for t in code)) or flags >= 0.5 * len(code)
        if gone:
            out.append(Edit(b.start, b.end))
    return out
