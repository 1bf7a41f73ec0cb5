"""Symbols and file facts of brace languages, found in their tokens (`lexing`).

Declarations are told by the tokens around them and end where their brackets pair, so they may lie anywhere in a line and over any number of lines. It is no
parser: types are skipped, not read. Where the rules ask for node levels of a syntax tree, brackets stand for them: two levels each, and one more for a variable.
"""

from __future__ import annotations

from tessera.operators.lexing import OPERATORS, Token, pairs, tokens

_MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "override", "get", "set", "abstract", "declare", "accessor"}
_TYPE_BEFORE = {"keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract", "is", "extends", "in"}
_TYPE_GOES_ON = {"|", "&", "=>", "?", ":", ".", "[", "extends", "is"}
_GOES_ON = {".", "?.", "?", ":", "+", "-", "*", "/", "%", "&&", "||", "??", "=>", "==", "===", "!=", "!==", "<", ">", "<=", "=", "(", "[", "instanceof", "in", "as", "satisfies", "|", "&"}
#: Words with which a declaration of a script can begin; others are methods of objects, which brackets follow.
_BEGIN = {"class", "interface", "enum", "type", "function", "const", "let", "var"}
NAMELESS = "anonymous"


class _Code:
    """Tokens without comments, their pairs, and the innermost bracket around each."""

    def __init__(self, source: str, language: str):
        every = tokens(source, language)
        self.source, self.language = source, language
        self.comments = [t for t in every if t.kind == "comment"]
        self.t: list[Token] = [t for t in every if t.kind not in ("comment", "directive")] if self.comments or language == "C++" else every
        self.texts = [text if kind == "name" or kind == "mark" else "" for kind, text, _, _ in self.t]
        self.pair, self.around = pairs(self.texts)
        self.opens = {b: a for a, b in self.pair.items()}

    def text(self, i: int) -> str:
        """The token's text if it is a name or mark, else ''."""
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def name(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "name" else None

    def new_line(self, i: int) -> bool:
        return 0 < i < len(self.t) and "\n" in self.source[self.t[i - 1].end : self.t[i].start]

    def after(self, i: int) -> int:
        """Past a bracketed group that opens at i, else past one token."""
        return self.pair.get(i, i) + 1

    def angles(self, i: int) -> int:
        """Past <...> at i, or i."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += {"<": 1, ">": -1}.get(self.text(i), 0)
            i = self.after(i)
            if not depth:
                return i
            if self.text(i) in (";", "}", ")", "]"):
                return i
        return i

    def type_end(self, i: int) -> int:
        """Past the type at i: up to what can't belong to it, a body's brace among that."""
        awaited = True
        while i < len(self.t):
            x = self.text(i)
            if not awaited and self.new_line(i) and x not in _TYPE_GOES_ON:
                return i
            if x in (",", ";", ")", "]", "}", "=") or (x == "{" and not awaited) or (x == "=>" and not awaited and self.text(i - 1) != ")"):
                return i
            if x == "<":
                i, awaited = self.angles(i), False
            elif x in ("(", "[", "{"):
                i, awaited = self.after(i), False
            else:
                awaited = x in _TYPE_BEFORE or (self.t[i].kind == "mark")
                i += 1
        return i

    def expression_end(self, i: int) -> int:
        """Past the expression at i."""
        first = i
        while i < len(self.t):
            x = self.text(i)
            if x in (",", ";", ")", "]", "}") or (i > first and self.new_line(i) and x not in _GOES_ON and not self._awaits(i - 1)):
                return i
            i = self.after(i)
        return i

    def _awaits(self, i: int) -> bool:
        return (self.t[i].kind == "mark" and self.t[i].text not in (")", "]", "}", "++", "--", "!")) or self.text(i) in OPERATORS

    def arrow(self, i: int) -> int | None:
        """Past the arrow function at i, if one begins there."""
        i += self.text(i) == "async" and not self.new_line(i + 1) and self.text(i + 1) != "=>"
        if self.name(i):
            i += 1
        else:
            i = self.angles(i)
            if self.text(i) != "(":
                return None
            i = self.after(i)
            if self.text(i) == ":":
                i = self._return_type(i + 1)
        if self.text(i) != "=>":
            return None
        return self.after(i + 1) if self.text(i + 1) == "{" else self.expression_end(i + 1)

    def _return_type(self, i: int) -> int:
        """Past the type at i, up to the arrow of the function whose result it is; types may hold arrows in brackets."""
        while i < len(self.t) and self.text(i) not in ("=>", ";", ",", ")", "]", "}"):
            i = self.angles(i) if self.text(i) == "<" else self.after(i)
        return i

    def decorated(self, i: int) -> int:
        """The first token of the decorators right before i, or i."""
        while True:
            j = self.opens.get(i - 1, i) - 1
            while self.name(j) and self.text(j - 1) == ".":
                j -= 2
            if not self.name(j) or self.text(j - 1) != "@":
                return i
            i = j - 1

    def body(self, i: int) -> int | None:
        """The brace of the body of a function whose type parameters or parameters begin at i; None for a mere signature."""
        i = self.angles(i)
        if self.text(i) != "(":
            return None
        i = self.after(i)
        if self.text(i) == ":":
            i = self.type_end(i + 1)
        return i if self.text(i) == "{" else None


def _script(code: _Code) -> list[tuple[str, str, int, int, int, int]]:
    """(kind, name, first token, last token, declaring token, levels it has of its own) of TypeScript and JavaScript."""
    typed, found = code.language.startswith("TypeScript"), []
    classes: dict[int, str | None] = {}

    def member(i: int, end: int) -> int:
        first = i
        while code.text(i) == "@":
            i += 2
            while code.text(i) == ".":
                i += 2
            i = code.after(i) if code.text(i) == "(" else i
            first = i
        while code.text(i) in _MODIFIERS and code.text(i + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}"):
            i += 1
        i += code.text(i) == "*"
        if i >= end:
            return end
        name = code.source[code.t[i].start : code.t[code.pair.get(i, i)].end]
        name = name.strip("\"'") if code.t[i].kind == "string" else name
        i = code.after(i)
        i += code.text(i) in ("?", "!")
        if code.text(i) in ("(", "<"):
            if brace := code.body(i):
                found.append(("method", name, first, code.pair[brace], first, 0))
                return code.pair[brace] + 1
            i = code.after(code.angles(i))
            return code.type_end(i + 1) if code.text(i) == ":" else i
        if code.text(i) == ":":
            i = code.type_end(i + 1)
        if code.text(i) == "=":
            if past := code.arrow(i + 1):
                found.append(("method", name, first, past - 1, first, 0))
                return past
            return code.expression_end(i + 1)
        return max(i, first + 1)

    def expression(i: int) -> bool:
        """Whether what begins at i is part of an expression."""
        before = code.text(i - 1)
        return i > 0 and (before in ("=", "(", ",", ":", "?", "[", "!", "+", "&&", "||", "??", "=>", "...", "<") or before in OPERATORS - {"default", "else", "do"})

    for i, (x, before, after) in enumerate(zip(code.texts, ["", *code.texts], [*code.texts[1:], ""], strict=False)):
        if x not in _BEGIN and after not in ("(", "<"):
            continue
        if before in (".", "?.") or (after == ":" and before in ("{", ",")):
            continue
        if x == "class" and code.t[i].kind == "name":
            named = code.name(i + 1) if code.text(i + 1) not in ("extends", "implements") else None
            j = code.angles(i + (2 if named else 1))
            while j < len(code.t) and code.text(j) != "{":
                j = code.angles(j) if code.text(j) == "<" else code.after(j)
            if j >= len(code.t):
                continue
            first = i - (code.text(i - 1) == "abstract")
            classes[j] = (named or NAMELESS) if not expression(first) else None
            if classes[j]:
                found.append(("class", classes[j], first, code.pair[j], first, 0))
            k = j + 1
            while k < code.pair[j]:
                k = member(k, code.pair[j]) if code.text(k) != ";" else k + 1
        elif typed and x in ("interface", "enum") and code.name(i + 1) and not expression(i):
            j = i + 2
            while j < len(code.t) and code.text(j) != "{":
                j = code.angles(j) if code.text(j) == "<" else code.after(j)
            if j < len(code.t):
                first = i - (code.text(i - 1) in ("const", "declare"))
                found.append((x, code.name(i + 1), first, code.pair[j], first, 0))
        elif typed and x == "type" and code.name(i + 1) and not expression(i) and code.text(code.angles(i + 2)) == "=":
            found.append(("type", code.name(i + 1), i, code.type_end(code.angles(i + 2) + 1) - 1, i, 0))
        elif x == "function":
            first = i - (before == "async")
            j = i + 1 + (code.text(i + 1) == "*")
            name = code.name(j) or NAMELESS
            brace = code.body(j + (name != NAMELESS))
            if brace and not expression(first) and (name != NAMELESS or code.text(first - 1) == "default"):
                found.append(("function", name, first, code.pair[brace], first, 0))
        elif x in ("const", "let", "var") and not (typed and code.text(i + 1) == "enum"):
            j, first = i + 1, i
            while code.name(j):
                name, start = code.name(j), (first if first == i else j)
                j += 1 + (code.text(j + 1) == "!")
                if code.text(j) == ":":
                    j = code.type_end(j + 1)
                if code.text(j) != "=":
                    break
                value = j + 1 + (code.text(j + 1) == "async")
                if code.text(value) == "function":
                    k = value + 1 + (code.text(value + 1) == "*")
                    brace = code.body(k + (code.name(k) is not None))
                    past = code.pair[brace] + 1 if brace else None
                else:
                    past = code.arrow(j + 1)
                if past:
                    found.append(("function", name, start, past - 1, i, 1))
                j = past or code.expression_end(j + 1)
                if code.text(j) != ",":
                    break
                first, j = j + 1, j + 1
        elif before in ("{", ",", "async", "get", "set", "*") and after in ("(", "<") and code.name(i) and x not in ("if", "for", "while", "switch", "catch", "function", "with"):
            start = i - (before in ("async", "get", "set", "*"))
            brace, owner = code.body(i + 1), code.around[i]
            if brace and code.text(start - 1) in ("{", ",") and owner >= 0 and owner not in classes and code.text(owner) == "{" and expression(owner) and code.text(owner - 1) != "=>":
                found.append(("method", x, start, code.pair[brace], start, 0))
    code.classes = classes
    return found


def _go(code: _Code) -> list[tuple]:
    found, i, n = [], 0, len(code.t)
    while i < n:
        x = code.text(i)
        if x == "func" and code.around[i] < 0 and (i == 0 or code.new_line(i) or code.text(i - 1) == ";"):
            j = i + 1
            kind = "method" if code.text(j) == "(" else "function"
            j = code.after(j) if kind == "method" else j
            name, j = code.name(j) or NAMELESS, j + 1
            while j < n and code.text(j) != "{" and not (code.new_line(j) and code.text(j - 1) not in (",", "(")):
                j = code.after(j + 1) if code.text(j) in ("interface", "struct") and code.text(j + 1) == "{" else code.after(j)
            last = code.pair[j] if code.text(j) == "{" else j - 1
            found.append((kind, name, i, last, i, 0))
        elif x == "type" and code.text(i - 1) not in (".", "(") and (code.name(i + 1) or code.text(i + 1) == "("):
            group = code.text(i + 1) == "("
            name = code.name(i + 2 if group else i + 1) or NAMELESS
            j = code.after(i + 1)
            while not group and j < n and not code.new_line(j) and code.text(j) not in (";", "}"):
                j = code.after(j)
            found.append(("class", name, i, j - 1, i, 0))
        i += 1
    return found


def _cpp(code: _Code) -> list[tuple]:
    found: list[tuple] = []
    code.classes = {}

    def scope(i: int, end: int) -> None:
        while i < end:
            first, head, call, starts = i, [], None, False
            while i < end:
                x = code.text(i)
                if x == "template" and code.text(i + 1) == "<":
                    i = code.angles(i + 1)
                    continue
                if x == ";" or (x == ":" and head and head[-1] in ("public", "private", "protected") and not call):
                    if call and head[-2:] in (["=", "default"], ["=", "delete"]):
                        found.append(("function", _cpp_name(code, call), first, i, first, 0))
                    i += 1
                    break
                if x == "{":
                    close = code.pair[i]
                    kind = next((w for w in head if w in ("namespace", "class", "struct", "union", "enum", "extern")), None)
                    if call and starts and (code.name(i - 1) or code.text(i - 1) == ">") and code.text(i - 1) not in ("const", "noexcept", "override", "final", "try"):
                        i = close + 1  # a member's initial value
                        continue
                    if call and "=" not in head:
                        while code.text(close + 1) == "catch":
                            close = code.pair[code.after(close + 2)]
                        found.append(("function", _cpp_name(code, call), first, close, first, 0))
                        i = close + 1
                        break
                    if kind in ("namespace", "extern"):
                        scope(i + 1, close)
                        i = close + 1
                        break
                    if kind in ("class", "struct"):
                        at = next(j for j in range(first, i) if code.text(j) == kind)
                        names = []
                        for j in range(at + 1, i):
                            if code.text(j) == ":":
                                break
                            if code.name(j) and code.name(j) not in ("final", "alignas") and code.around[j] == code.around[at]:
                                names.append(code.name(j))
                        code.classes[i] = names[-1] if names else NAMELESS
                        found.append(("class", code.classes[i], first, close, first, 0))
                        scope(i + 1, close)
                    head.append("{}")
                    i = close + 1
                    continue
                if x == "(" and not call and head and "=" not in head and (code.name(i - 1) or "operator" in head):
                    call = i
                if x == "operator" and code.text(i + 1) == "(":
                    head.append(x)
                    i = code.after(i + 1)
                    continue
                starts = starts or (x == ":" and call is not None)
                head.append(x)
                i = code.angles(i) if x == "<" and "operator" not in head and code.name(i - 1) else code.after(i)

    scope(0, len(code.t))
    return found


def _cpp_name(code: _Code, call: int) -> str:
    i = call - 1
    for j in range(i, max(-1, i - 5), -1):
        if code.text(j) == "operator":
            return "operator" + "".join(t.text for t in code.t[j + 1 : call])
    return ("~" if code.text(i - 1) == "~" else "") + (code.name(i) or NAMELESS)


def _levels(code: _Code, token: int, own: int) -> list[tuple[int, int]]:
    """(bracket around, levels above the token that what it belongs to lies), from the inside out."""
    out, at, levels = [], code.around[token], own
    while at >= 0:
        levels += 2
        out.append((at, levels))
        at = code.around[at]
    return out


def symbols(language: str, source: str) -> list[tuple]:
    """(kind, name, parent, exported, docstring, first line, last line), lines from 0, in the order of the source; comments and decorators right above a symbol belong to it.

    Parent: the class or struct within six levels. Exported: an export within three levels, so that methods of an exported class are. What has no name is anonymous. LexingError for a source whose tokens don't end or pair.
    """
    code = _Code(source, language)
    code.classes = {}
    script = language.startswith(("TypeScript", "JavaScript"))
    raw = _script(code) if script else _go(code) if language == "Go" else _cpp(code) if language == "C++" else []
    starts = {first: (kind, declared) for kind, _, first, _, declared, _ in raw}
    bodies: dict[int, int] = {}  # brace of a declaration's body -> its first token
    for _, _, first, last, _, _ in raw:
        for i in range(first, last + 1):
            if code.pair.get(i) == last and code.text(i) == "{":
                bodies[i] = first
                break
    line_of = _line_numbers(source)
    comments = {line_of(c.end - 1): c for c in code.comments if not source[source.rfind("\n", 0, c.start) + 1 : c.start].strip()}  # by last line; those that begin a line

    def exported(declared: int) -> bool:
        return script and (code.text(declared - 1) == "export" or (code.text(declared - 1) == "default" and code.text(declared - 2) == "export"))

    out = []
    for kind, name, first, last, declared, own in sorted(raw, key=lambda r: (r[2], -r[3])):
        parent, shown = None, exported(declared)
        for brace, levels in _levels(code, declared, own):
            if levels > 6:
                break
            if brace in code.classes:
                parent = code.classes[brace] if code.classes[brace] != NAMELESS else None
                break
        for brace, levels in _levels(code, declared, own)[:1]:
            owner = bodies.get(brace)
            if levels < 3 and owner is not None and starts[owner][0] in ("class", "function") and code.text(owner) not in ("const", "let", "var"):
                shown = shown or exported(starts[owner][1])
        start = declared
        while script and code.text(start - 1) in ("export", "default", "declare", "abstract", "async"):
            start -= 1
        above, docs = line_of(code.t[code.decorated(min(start, first))].start), []
        while above:
            said = comments.get(above - 1)
            if not said:
                break
            docs.insert(0, said.text)
            above = line_of(said.start)
        out.append((kind, name, parent, shown, "\n".join(docs) or None, above, line_of(code.t[last].end - 1)))
    return out


def _line_numbers(source: str):
    from bisect import bisect_right

    ends = [i for i, c in enumerate(source) if c == "\n"]
    return lambda at: bisect_right(ends, at - 1) if at else 0


def facts(language: str, source: str) -> list[tuple]:
    """Distinct (kind, name, target): import (specifier), export (its first line), decorator (its text), inheritance (class, base). Go and C++ give none."""
    if not language.startswith(("TypeScript", "JavaScript")):
        return []
    code = _Code(source, language)
    found: dict[tuple, None] = {}
    for i, t in enumerate(code.t):
        x = code.text(i)
        if code.text(i - 1) in (".", "?."):
            continue
        if x == "import" and code.text(i + 1) not in ("(", ".", ":") and code.around[i] < 0:
            j = i + 1
            while j < len(code.t) and code.t[j].kind != "string" and code.text(j) not in (";", "=") and not (code.new_line(j) and code.text(j - 1) not in ("from", "import", "type", ",", "}")):
                j = code.after(j)
            if j < len(code.t) and code.t[j].kind == "string":
                found["import", code.t[j].text.strip("\"'"), None] = None
            elif code.text(j) == "=":
                found["import", source[t.start :].split("\n")[0].strip(), None] = None
        elif x == "export" and code.around[i] < 0:
            found["export", source[t.start :].split("\n")[0].strip(), None] = None
        elif x == "@" and code.name(i + 1):
            j = i + 2
            while code.text(j) == ".":
                j += 2
            j = code.after(j) if code.text(j) == "(" else j
            found["decorator", source[t.start : code.t[j - 1].end], None] = None
        elif x == "class" and code.name(i + 1) and code.text(i + 1) != "extends":
            j = code.angles(i + 2)
            if code.text(j) == "extends" and code.name(j + 1):
                k = j + 2
                while code.text(k) == ".":
                    k += 2
                found["inheritance", code.name(i + 1), source[code.t[j + 1].start : code.t[k - 1].end]] = None
    return list(found)
