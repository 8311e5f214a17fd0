"""Tokens of source texts with matched brackets, the comments between them, and what comments say."""

from __future__ import annotations

import re
from bisect import bisect_right

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
STRING = r"\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'"
WORD, NUMBER = r"[^\W\d][\w$]*|[$@#]?[$A-Za-z_][\w$]*", r"\d[\w.]*"

GO = re.compile(rf"(?P<comment>{LINE_COMMENT}|{BLOCK_COMMENT})|(?P<string>`[^`]*`|{STRING})|(?P<word>[^\W\d]\w*)|(?P<number>{NUMBER})|(?P<mark>\.\.\.|:=|\S)")
RUST = re.compile(rf"(?P<comment>{LINE_COMMENT}|{BLOCK_COMMENT})|(?P<string>b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n']+|\\'|[^'\\\n])')|(?P<word>'?[^\W\d]\w*)|(?P<number>{NUMBER})|(?P<mark>->|=>|::|\.\.=?|\S)")
SCRIPT = re.compile(rf"(?P<comment>{LINE_COMMENT}|{BLOCK_COMMENT})|(?P<string>{STRING})|(?P<word>[#$]?[^\W\d][\w$]*|\$)|(?P<number>{NUMBER})|(?P<mark>=>|\.\.\.|\?\.|\?\?|&&|\|\||\S)")
#: A slash after one of these words or after an opening mark begins a regular expression.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


class Tokens:
    """text, kind, place and line of each token; close: the closing bracket of each opening one, the end if it has none."""

    def __init__(self, source: str, rules: re.Pattern, script: bool = False):
        self.source, self.text, self.kind, self.start, self.end = source, [], [], [], []
        self.comments: list[tuple[int, int, int]] = []  # start, end, number of the token that follows
        self.rows = [m.start() for m in re.finditer("\n", source)]
        at, n = 0, len(source)
        while m := rules.search(source, at):
            kind, at, stop = m.lastgroup if m.lastgroup != "h" else "string", m.start(), m.end()
            if kind == "comment":
                self.comments.append((at, stop, len(self.text)))
                at = stop
                continue
            if script and source[at] == "`":
                kind, stop = "string", self.template(at)
            elif script and source[at] == "/" and self.regex_may_begin() and (r := REGEX.match(source, at)):
                kind, stop = "string", r.end()
            self.text.append(source[at:stop])
            self.kind.append(kind)
            self.start.append(at)
            self.end.append(stop)
            at = stop
        self.n, self.close, stack = len(self.text), {}, []
        for i, x in enumerate(self.text):
            if self.kind[i] == "mark":
                if x in OPEN:
                    stack.append(i)
                elif x in CLOSE:
                    while stack and OPEN[self.text[stack[-1]]] != x:
                        if not any(OPEN[self.text[k]] == x for k in stack[-4:]):
                            break
                        self.close[stack.pop()] = i
                    if stack and OPEN[self.text[stack[-1]]] == x:
                        self.close[stack.pop()] = i
        for i in stack:
            self.close[i] = self.n
        del n

    def template(self, at: int) -> int:
        """Where the template that begins there ends, whatever stands in its ${}."""
        s, depth, i = self.source, [], at + 1
        while i < len(s):
            c = s[i]
            if c == "\\":
                i += 1
            elif not depth or depth[-1] == "`":
                if c == "`":
                    if not depth:
                        return i + 1
                    depth.pop()
                elif s.startswith("${", i):
                    depth.append("{")
                    i += 1
            elif c == "`":
                depth.append("`")
            elif c == "{":
                depth.append("{")
            elif c == "}":
                depth.pop()
            i += 1
        return len(s)

    def regex_may_begin(self) -> bool:
        if not self.text:
            return True
        x, kind = self.text[-1], self.kind[-1]
        return x in BEFORE_REGEX if kind == "word" else kind == "mark" and x not in (")", "]", "}")

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.text[i] in texts

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "word"

    def line(self, i: int) -> int:
        return bisect_right(self.rows, self.start[min(i, self.n - 1)] - 1) + 1 if self.n else 1

    def last_line(self, i: int) -> int:
        """The line on which token i ends."""
        return bisect_right(self.rows, self.end[min(i, self.n - 1)] - 1) + 1 if self.n else 1

    def cut(self, i: int, j: int) -> str:
        """The source of tokens i to j - 1."""
        return self.source[self.start[i] : self.end[j - 1]].strip() if i < j else ""

    def after(self, i: int) -> int:
        """The token behind the bracket that opens at i."""
        return min(self.close.get(i, i), self.n - 1) + 1

    def angles(self, i: int) -> int:
        """The token behind the < that opens at i; brackets inside are skipped whole."""
        depth = 0
        while i < self.n:
            x = self.text[i]
            if x in OPEN and self.kind[i] == "mark":
                i = self.after(i)
                continue
            depth += (x == "<") - (x == ">")
            i += 1
            if not depth:
                break
        return i

    def split(self, i: int, j: int, mark: str = ",") -> list[tuple[int, int]]:
        """Parts of tokens i to j - 1 between the marks outside any bracket, angles too; none empty."""
        out, begin, k = [], i, i
        while k < j:
            if self.text[k] in OPEN and self.kind[k] == "mark":
                k = self.after(k)
            elif self.text[k] == "<" and self.kind[k] == "mark":
                k = self.angles(k)
            elif self.text[k] == mark:
                out.append((begin, k))
                begin = k = k + 1
            else:
                k += 1
        out.append((begin, j))
        return [(a, b) for a, b in out if a < b]

    def comments_before(self, i: int) -> list[tuple[str, int, int]]:
        """(text, first line, last line) of the comments between token i and the one before it."""
        lo = bisect_right(self.comments, i - 1, key=lambda c: c[2])
        hi = bisect_right(self.comments, i, key=lambda c: c[2])
        row = lambda p: bisect_right(self.rows, p - 1) + 1
        return [(self.source[a:b], row(a), row(b)) for a, b, _ in self.comments[lo:hi]]

    def said_above(self, i: int) -> str | None:
        """What the last comment before token i says, if it ends on the line above or later."""
        found = self.comments_before(i)
        return bare(found[-1][0]) if found and found[-1][2] >= self.line(i) - 1 else None


def bare(comment: str) -> str:
    """A comment without its marks."""
    text = comment[3:] if comment.startswith("/**") else comment[2:] if comment.startswith("/*") else comment
    out = []
    for x in text.removesuffix("*/").split("\n"):
        x = x.strip()
        x = x[2:] if x.startswith("* ") else "" if x == "*" else x
        for mark in ("///", "//"):
            if x.startswith(mark):
                x = x[len(mark) :].removeprefix(" ")
                break
        out.append(x[1:].removeprefix(" ") if x.startswith("#") else x)
    return "\n".join(out).strip()


def short(text: str) -> str:
    return text[:97] + "..." if len(text) > 100 else text


def function(name, line, end_line, parameters=(), return_type=None, type_parameters=(), is_async=False, is_generator=False, visibility="public", decorators=(), docstring=None) -> dict:
    return {
        "name": name, "parameters": list(parameters), "return_type": return_type, "type_parameters": list(type_parameters), "is_async": is_async, "is_generator": is_generator, "visibility": visibility, "decorators": list(decorators),
        "docstring": docstring or None, "line": line, "end_line": end_line,
    }


def klass(name, line, end_line, type_parameters=(), extends=(), implements=(), fields=(), methods=(), decorators=(), docstring=None, visibility="public") -> dict:
    return {
        "name": name, "type_parameters": list(type_parameters), "extends": list(extends), "implements": list(implements), "mixins": [], "fields": list(fields), "methods": list(methods), "decorators": list(decorators), "docstring": docstring or None,
        "visibility": visibility, "line": line, "end_line": end_line,
    }


def parameter(name, type_=None, default=None, is_rest=False) -> dict:
    return {"name": name, "type": type_ or None, "default_value": default or None, "is_rest": is_rest}


def field(name, type_=None, visibility="public", is_static=False, is_readonly=False) -> dict:
    return {"name": name, "type": type_ or None, "visibility": visibility, "is_static": is_static, "is_readonly": is_readonly}


def imported(source, specifiers, line, is_type_only=False) -> dict:
    return {"source": source, "specifiers": specifiers, "is_type_only": is_type_only, "line": line}


def specifier(name, alias=None, is_default=False, is_namespace=False) -> dict:
    return {"name": name, "alias": alias, "is_default": is_default, "is_namespace": is_namespace}


def exported(name, kind, line, source=None, is_type_only=False) -> dict:
    return {"name": name, "kind": kind, "is_re_export": source is not None or kind == "re-export", "source": source, "is_type_only": is_type_only, "line": line}


def constant(name, line, type_=None, value=None, is_exported=True, docstring=None) -> dict:
    return {"name": name, "type": type_ or None, "value": value, "is_exported": is_exported, "docstring": docstring or None, "line": line}


def empty() -> dict:
    return {"functions": [], "classes": [], "imports": [], "exports": [], "constants": [], "re_exports": [], "parse_errors": []}
