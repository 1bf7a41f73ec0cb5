"""Tokens of brace languages, by a lexer with a stack of modes.

Templates hold code and code holds templates, elements of JSX hold text, code and elements, at any depth; so what a character means depends on the mode it is
met in. A slash begins a regular expression where an operand is awaited, else it divides.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    """kind: name, number, string, template, regex, text (of an element), mark, comment, directive (of the preprocessor). `start` and `end` are places in the source."""

    kind: str
    text: str
    start: int
    end: int


class LexingError(ValueError):
    """A source that can't be cut into tokens."""


_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff#][\w$\u0080-\U0010ffff]*")
#: Names and marks that mean the same in any code, one after another: what most code is made of.
_PLAIN = re.compile(r"\s*(?:([A-Za-z_$][\w$\u0080-\U0010ffff]*)(?![\"'\w$\u0080-\U0010ffff])|([()\[\];,]))")
_KINDS = (None, "name", "mark")
_NUMBER = re.compile(r"\.?\d(?:[eEpP][+-]|['\w.])*")
_SPACE = re.compile(r"\s+")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_STRING = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}", re.S) for q in "\"'"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_RAW = re.compile(r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\((.*?)\)\1"', re.S)
_DIRECTIVE = re.compile(r"#(?:\\\n|[^\n])*")
_MARK = re.compile(r"=>|\.\.\.|->|::|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|[=!]==?|:=|<-|\+\+|--|<=|[-+*/%&|^]=|.", re.S)
_ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>]))")
_GENERIC = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|extends\b|=[^>])")
#: Names after which an operand is awaited.
OPERATORS = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "await", "yield", "default", "extends"}


def operand_next(last: Token | None) -> bool:
    """Whether an operand can follow: at the start, after operators and opening marks."""
    if last is None:
        return True
    if last.kind == "mark":
        return last.text not in (")", "]", "}", "++", "--")
    return last.kind == "name" and last.text in OPERATORS


def tokens(source: str, language: str) -> list[Token]:
    """The tokens of a source, comments among them. LexingError if a string, comment, template or element doesn't end."""
    script, elements = language.startswith(("TypeScript", "JavaScript")), "React" in language or language == "JavaScript"
    found: list[Token] = []
    modes: list[str] = ["code"]  # code, template, tag (inside < >), inside (between tags)
    depths = [0]  # open braces of each mode of code
    last: Token | None = None
    at, n = 0, len(source)
    plain, token, append = _PLAIN.match, tuple.__new__, found.append  # looked up once

    def add(kind: str, end: int) -> None:
        nonlocal at, last
        found.append(Token(kind, source[at:end], at, end))
        last, at = (last if kind in ("comment", "directive") else found[-1]), end

    while at < n:
        c, mode = source[at], modes[-1]
        if mode == "template":
            end = at
            while end < n and source[end] != "`" and source[end : end + 2] != "${":
                end += 2 if source[end] == "\\" else 1
            if end >= n:
                raise LexingError("a template that does not end")
            if end > at:
                add("template", end)
            if source[at] == "`":
                add("template", at + 1)
                modes.pop()
            else:
                add("mark", at + 2)
                modes.append("code")
                depths.append(0)
            continue
        if mode == "inside":
            end = next((i for i in range(at, n) if source[i] in "<{"), n)
            if end == n:
                raise LexingError("an element that does not end")
            if end > at:
                add("text", end)
            elif c == "{":
                add("mark", at + 1)
                modes.append("code")
                depths.append(0)
            elif source.startswith("</", at):
                close = source.find(">", at)
                if close < 0:
                    raise LexingError("an element that does not end")
                add("text", close + 1)
                modes.pop()
            else:
                add("text", _ELEMENT.match(source, at).end() if _ELEMENT.match(source, at) else at + 1)
                modes.append("inside" if found[-1].text == "<>" else "tag")
            continue
        if mode == "code":
            before = at
            while m := plain(source, at):
                kind = m.lastindex
                start, at = m.span(kind)
                append(token(Token, (_KINDS[kind], m[kind], start, at)))
            last = found[-1] if at > before else last
            if at >= n:
                break
            c = source[at]
        if m := _SPACE.match(source, at):
            at = m.end()
            continue
        if c == "/" and (m := _COMMENT.match(source, at)):
            add("comment", m.end())
            continue
        if mode == "tag":
            if source.startswith("/>", at):
                add("text", at + 2)
                modes.pop()
            elif c == ">":
                add("text", at + 1)
                modes[-1] = "inside"
            elif c == "{":
                add("mark", at + 1)
                modes.append("code")
                depths.append(0)
            elif c in "\"'":
                end = source.find(c, at + 1) + 1
                if not end:
                    raise LexingError("a string that does not end")
                add("string", end)
            else:
                add("text", m.end() if (m := re.compile(r"[^\s\"'{}<>/]+").match(source, at)) else at + 1)
            continue
        if source.startswith("/*", at):
            raise LexingError("a comment that does not end")
        if language == "C++" and (m := _RAW.match(source, at)):
            add("string", m.end())
        elif language == "C++" and c == "#":
            add("directive", _DIRECTIVE.match(source, at).end())
        elif c == "`" and script:
            add("template", at + 1)
            modes.append("template")
        elif c == "`":
            end = source.find("`", at + 1) + 1
            if not end:
                raise LexingError("a string that does not end")
            add("string", end)
        elif c in "\"'":
            m = _STRING[c].match(source, at)
            if not m:
                raise LexingError("a string that does not end")
            add("string", m.end())
        elif c.isdigit() or (c == "." and source[at + 1 : at + 2].isdigit()):
            add("number", _NUMBER.match(source, at).end())
        elif m := _NAME.match(source, at):
            add("name", m.end())
        elif script and c == "/" and operand_next(last) and (m := _REGEX.match(source, at)):
            add("regex", m.end())
        elif elements and c == "<" and operand_next(last) and (m := _ELEMENT.match(source, at)) and not _GENERIC.match(source, at):
            add("text", m.end())
            modes.append("inside" if m.group() == "<>" else "tag")
        else:
            add("mark", _MARK.match(source, at).end() if c not in "<>{}()[];," else at + 1)
            if c == "{":
                depths[-1] += 1
            elif c == "}" and len(modes) > 1 and not depths[-1]:
                modes.pop()
                depths.pop()
            elif c == "}":
                depths[-1] -= 1
    if len(modes) > 1:
        raise LexingError(f"a {modes[-1]} that does not end")
    return found


OPENING = {"(": ")", "[": "]", "{": "}", "${": "}"}


CLOSING = set(OPENING.values())


def pairs(texts: list[str]) -> tuple[dict[int, int], list[int]]:
    """Where each opening mark closes, by place in the list, and the innermost bracket around each place (-1: none). `texts` are those of names and marks, '' for other tokens. LexingError where they don't balance."""
    out, around, open_, inner = {}, [], [], -1
    for i, text in enumerate(texts):
        if text in CLOSING:
            if inner < 0 or OPENING[texts[inner]] != text:
                raise LexingError(f"a {text} that nothing opens")
            out[inner] = i
            inner = open_.pop()
            around.append(inner)
        elif text in OPENING:
            around.append(inner)
            open_.append(inner)
            inner = i
        else:
            around.append(inner)
    if inner >= 0:
        raise LexingError(f"a {texts[inner]} that does not close")
    return out, around
