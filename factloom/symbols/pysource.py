"""Symbols of Python, from the syntax trees of the interpreter that runs this; a file it cannot parse has none."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from factloom.symbols.tokens import bare, constant, empty, exported, field, function, imported, klass, parameter, short, specifier

QUOTES = ('"""', "'''", '"', "'")


def visibility(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


def unquoted(raw: str) -> str:
    """A docstring without its quotes and the indent that its lines after the first share."""
    for q in QUOTES:
        if raw.startswith(q) and raw.endswith(q):
            raw = raw[len(q) : len(raw) - len(q)]
            break
    first, *rest = raw.split("\n")
    least = min((len(x) - len(x.lstrip()) for x in rest if x.strip()), default=0)
    return "\n".join([first.strip(), *(x[least:] for x in rest)]).strip()


class Module:
    def __init__(self, source: str):
        self.lines = [x.encode() for x in source.split("\n")]
        self.tree, self.out, self.remarks = ast.parse(source), empty(), {}
        if "#" in source:
            for t in tokenize.generate_tokens(io.StringIO(source).readline):
                if t.type == tokenize.COMMENT:
                    self.remarks[t.start[0]] = t.string

    def text(self, node) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset : node.end_col_offset].decode()
        return b"\n".join([self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]]).decode()

    def doc(self, body) -> str | None:
        if not body or not isinstance(body[0], ast.Expr):
            return None
        v = body[0].value
        said = isinstance(v, ast.Constant) and isinstance(v.value, str) or isinstance(v, ast.JoinedStr)
        return unquoted(self.text(v)) if said else None

    def parameters(self, a: ast.arguments, method: bool) -> list[dict]:
        out, plain = [], [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults

        def add(x, default):
            nonlocal method
            if method and x.arg in ("self", "cls"):
                method = False
                return
            out.append(parameter(x.arg, x.annotation and self.text(x.annotation), default and self.text(default)))

        def splat(x, mark, kind):
            out.append(parameter(mark + x.arg, self.text(x.annotation)) if x.annotation else parameter(x.arg, kind, None, True))

        for x, d in zip(plain, defaults, strict=True):
            add(x, d)
        if a.vararg:
            splat(a.vararg, "*", None)
        for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True):
            add(x, d)
        if a.kwarg:
            splat(a.kwarg, "**", "dict")
        return out

    def decorators(self, node) -> list[str]:
        return ["@" + self.text(d) for d in node.decorator_list]

    def function(self, f, method: bool) -> dict:
        return function(f.name, f.lineno, f.end_lineno, self.parameters(f.args, method), f.returns and self.text(f.returns), is_async=isinstance(f, ast.AsyncFunctionDef), visibility=visibility(f.name), decorators=self.decorators(f), docstring=self.doc(f.body))

    def target(self, s):
        """(target, type, value) of an assignment; of a chain the first target."""
        if isinstance(s, ast.Assign):
            return s.targets[0], None, s.targets[1] if len(s.targets) > 1 else s.value
        return (s.target, s.annotation, s.value) if isinstance(s, ast.AnnAssign) else (None, None, None)

    def klass(self, c: ast.ClassDef) -> dict:
        fields, methods = [], []
        for s in c.body:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                for x in s.body if s.name == "__init__" else ():
                    left, _, _ = self.target(x)
                    if isinstance(left, ast.Attribute) and isinstance(left.value, ast.Name) and left.value.id == "self" and all(f["name"] != left.attr for f in fields):
                        fields.append(field(left.attr, None, visibility(left.attr)))
                methods.append(self.function(s, True))
            else:
                left, kind, _ = self.target(s)
                if isinstance(left, ast.Name):
                    fields.append(field(left.id, kind and self.text(kind), visibility(left.id), True))
        return klass(c.name, c.lineno, c.end_lineno, (), [self.text(b) for b in c.bases], (), fields, methods, self.decorators(c), self.doc(c.body), visibility(c.name))

    def value_text(self, s, value) -> str | None:
        if value is None:
            return None
        if isinstance(s, ast.Assign) and len(s.targets) > 1:  # the rest of a chain is its value
            end = s.value
            whole = ast.Constant(0, lineno=value.lineno, col_offset=value.col_offset, end_lineno=end.end_lineno, end_col_offset=end.end_col_offset)
            return short(self.text(whole))
        return short(self.text(value))

    def run(self) -> dict:
        out, listed = self.out, None
        export = lambda name, kind, line: out["exports"].append(exported(name, kind, line))
        for s in self.tree.body:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                out["functions"].append(self.function(s, False))
                export(s.name, "function", s.lineno)
            elif isinstance(s, ast.ClassDef):
                out["classes"].append(self.klass(s))
                export(s.name, "class", s.lineno)
            elif isinstance(s, ast.Import):
                names = [specifier(a.name, a.asname, False, True) for a in s.names]
                out["imports"].append(imported(names[0]["name"], names, s.lineno))
            elif isinstance(s, ast.ImportFrom) and s.module != "__future__":
                names = [specifier(a.name, a.asname, False, a.name == "*") for a in s.names]
                out["imports"].append(imported("." * s.level + (s.module or ""), names, s.lineno))
            else:
                left, kind, value = self.target(s)
                if isinstance(left, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", left.id):
                    above = self.remarks.get(s.lineno - 1, None) if s.lineno > 1 and self.lines[s.lineno - 2].lstrip().startswith(b"#") else None
                    out["constants"].append(constant(left.id, s.lineno, kind and self.text(kind), self.value_text(s, value), True, above and bare(above)))
                    export(left.id, "variable", s.lineno)
                if listed is None and isinstance(left, ast.Name) and left.id == "__all__" and value is not None:
                    listed = [e.value for e in getattr(value, "elts", ()) if isinstance(value, ast.List | ast.Tuple) and isinstance(e, ast.Constant) and isinstance(e.value, str) and e.value]
        out["re_exports"] += [exported(name, "re-export", 1) for name in listed or ()]
        return out


def extract(source: str, language: str = "python") -> dict:
    try:
        return Module(source.replace("\r\n", "\n").replace("\r", " ")).run()
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
        return empty() | {"parse_errors": [{"line": getattr(e, "lineno", None) or 1, "message": str(e)}]}
