"""Tokens of source text, in one linear pass with a stack of modes.

Each language has one pattern of what may stand in code; strings, templates (with code
inside ``${}`` at any depth), regular expressions and comments are told apart from it, so that nothing in
them is taken for code.  Brackets are matched as they come.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SCRIPT = frozenset(["typescript", "tsx", "javascript", "jsx"])

_SPACE = r"(?P<space>[^\S\n]+)|(?P<line>\n)"
_WORD = r"(?P<w>[^\W\d][\w$]*|[$#][\w$]*)"
_NUMBER = r"(?P<n>\d(?:[\w.]|(?<=[eE])[+-])*)"
_SLASH_NOTES = r"(?P<note>//[^\n]*|/\*[\s\S]*?\*/)|(?P<openNote>/\*[\s\S]*)"
_QUOTED = r"(?P<s>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<openString>[\"'][^\n]*)"
_OPERATORS = r"(?P<p>=>|===?|!==?|->|:=|::|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|\+\+|--|[-+*/%&|^]=|<=|>=|\.\.\.|[^\s])"
PATTERNS = {
    "script": re.compile("|".join([_SPACE, _SLASH_NOTES, _QUOTED, r"(?P<tick>`)", _NUMBER, _WORD, _OPERATORS])),
    "python": re.compile("|".join([
        _SPACE, r"(?P<note>\#[^\n]*|\\\n)",
        r"(?P<s>[rRbBfFuUtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))",
        r"(?P<openString>[rRbBfFuUtT]{0,2}(?:\"\"\"[\s\S]*|'''[\s\S]*|[\"'][^\n]*))", _NUMBER, _WORD, _OPERATORS,
    ])),
    "go": re.compile("|".join([_SPACE, _SLASH_NOTES, r"(?P<s>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')|(?P<openString>`[\s\S]*|[\"'][^\n]*)", _NUMBER, _WORD, _OPERATORS])),
    "rust": re.compile("|".join([
        _SPACE, r"(?P<note>//[^\n]*)|(?P<nested>/\*)", r"(?P<s>b?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{\w+\}|x\w\w|.))')",
        r"(?P<life>'[^\W\d]\w*)", r"(?P<openString>[bc]?\"[\s\S]*|')", _NUMBER, _WORD, _OPERATORS,
    ])),
}
#: After these words a slash begins a regular expression.
_BEFORE_VALUE = frozenset("return typeof case in of do else void delete instanceof new throw yield await".split())
_HEADS = frozenset("if for while with".split())
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_NOTE_EDGE = re.compile(r"/\*|\*/")
PAIRS = {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    """``kind``: w word, n number, s string (text without its quotes), t part of a template, r regular expression, p other; ``first``: first of its line."""

    kind: str
    text: str
    start: int
    end: int
    line: int
    first: bool


class Tokens(NamedTuple):
    """``match``: the other bracket of a pair, else -1; ``inside``: the bracket around a token, else -1; ``errors``: what does not fit, by place; ``cut``: whether a bracket stays open to the end."""

    all: list[Token]
    match: list[int]
    inside: list[int]
    errors: list[str]
    lines: int
    cut: bool


def family(language: str | None) -> str | None:
    return "script" if language in SCRIPT else language if language in PATTERNS else None


def unquoted(text: str) -> str:
    """The content of a string literal."""
    text = re.sub(r"^(?:b?r#*(?=\")|[A-Za-z]{1,2}(?=[\"']))", "", text)
    if text[:3] in ('"""', "'''") and len(text) >= 6:
        return text[3:-3]
    return re.sub(r"\\(.)", r"\1", text.rstrip("#")[1:-1], flags=re.S)


def tokens(source: str, language: str) -> Tokens:
    kind = family(language)
    pattern = PATTERNS[kind]
    out: list[Token] = []
    match: list[int] = []
    inside: list[int] = []
    errors: list[str] = []
    stack: list[int] = []  # open brackets; a template's is the part before its ${
    at, line, first, size = 0, 1, True, len(source)

    def put(what: str, text: str, start: int, end: int) -> None:
        nonlocal first
        out.append(Token(what, text, start, end, line, first))
        match.append(-1)
        inside.append(stack[-1] if stack else -1)
        first = False

    def template(start: int) -> int:
        """Reads a template's text from ``start``: up to its end, or into ``${``."""
        nonlocal line
        m = _TEMPLATE.match(source, start)
        end = m.end()
        put("t", m[0], start, end)
        line += m[0].count("\n")
        if source.startswith("${", end):
            stack.append(len(out) - 1)
            return end + 2
        if end >= size:
            errors.append(f"template not closed in line {out[-1].line}")
        return end + 1

    while at < size:
        m = pattern.match(source, at)
        what, text, start = m.lastgroup, m[0], at
        if what == "h":
            what = "s"
        at = m.end()
        if what == "space":
            continue
        if what == "line":
            line, first = line + 1, True
        elif what == "note":
            line += text.count("\n")
        elif what == "nested":
            depth = 1
            while depth and (edge := _NOTE_EDGE.search(source, at)):
                depth, at = depth + (1 if edge[0] == "/*" else -1), edge.end()
            if depth:
                errors.append(f"comment not closed in line {line}")
                at = size
            line += source.count("\n", start, at)
        elif what == "openNote":
            errors.append(f"comment not closed in line {line}")
            break
        elif what == "tick":
            at = template(at)
        elif what == "s":
            put("s", unquoted(text), start, at)
            line += text.count("\n")
        elif what == "openString":
            if text[0] == "'" and language in ("tsx", "jsx"):  # an apostrophe of the markup
                at = start + 1
                continue
            errors.append(f"string not closed in line {line}")
            put("s", text[1:], start, at)
            line += text.count("\n")
        elif what == "life":
            put("n", text, start, at)
        elif what != "p":
            put(what, text, start, at)
        elif text in "([{":
            put("p", text, start, at)
            stack.append(len(out) - 1)
        elif text in PAIRS:
            if text == "}" and stack and out[stack[-1]].kind == "t":
                stack.pop()
                at = template(at)
                continue
            want = PAIRS[text]
            while stack and out[stack[-1]].text != want and any(out[k].text == want and out[k].kind == "p" for k in stack[-8:]):
                errors.append(f"{out[stack[-1]].text} not closed in line {out[stack[-1]].line}")
                stack.pop()
            if stack and out[stack[-1]].text == want and out[stack[-1]].kind == "p":
                opened = stack.pop()
                put("p", text, start, at)
                match[opened], match[-1] = len(out) - 1, opened
            else:
                errors.append(f"unexpected {text} in line {line}")
                put("p", text, start, at)
        elif kind == "script" and text[0] == "/" and _opens_regex(out, match) and (found := _REGEX.match(source, start)):
            at = found.end()
            put("r", found[0], start, at)
        else:
            put("p", text, start, at)
    if stack:
        errors.append(f"{len(stack)} blocks not closed")
    for k in stack:
        match[k] = len(out) - 1
    return Tokens(out, match, inside, errors, source.count("\n") + 1, bool(stack))


def _opens_regex(out: list[Token], match: list[int]) -> bool:
    """Whether a slash after these tokens begins a regular expression and divides nothing."""
    if not out:
        return True
    last = out[-1]
    if last.kind == "w":
        return last.text in _BEFORE_VALUE
    if last.kind != "p":
        return False
    if last.text == ")":  # after the head of a statement
        return match[-1] > 0 and out[match[-1] - 1].text in _HEADS
    return last.text != "]"
