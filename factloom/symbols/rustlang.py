"""Symbols of Rust."""

from __future__ import annotations

import re

from factloom.symbols.tokens import RUST, Tokens, bare, constant, empty, exported, field, function, imported, klass, parameter, specifier

BEFORE_FN = frozenset("async unsafe const extern default".split())


class Rust:
    def __init__(self, source: str):
        self.t, self.out, self.types = Tokens(source, RUST), empty(), {}

    def attributes(self, i: int) -> tuple[list[tuple[int, int]], int]:
        t, out = self.t, []
        while t.is_(i, "#"):
            k = i + 1 + t.is_(i + 1, "!")
            if not t.is_(k, "["):
                break
            out.append((i, t.after(k)))
            i = t.after(k)
        return out, i

    def decorators(self, marks, i: int) -> list[str]:
        """Those attributes that nothing, no comment either, parts from the item at i."""
        out = []
        for a, b in reversed(marks):
            if self.t.comments_before(i):
                break
            out.insert(0, self.t.cut(a, b))
            i = a
        return out

    def said(self, marks, i: int) -> str | None:
        """Documentation above the item at i and its attributes, else the comment right above the item."""
        out = []
        for at in [i, *(a for a, _ in reversed(marks))]:
            for text, _, _ in reversed(self.t.comments_before(at)):
                if not text.startswith(("///", "/**", "//!")):
                    return self.cleaned(out) or self.t.said_above(i)
                out.insert(0, text)
        return self.cleaned(out) or self.t.said_above(i)

    def cleaned(self, comments) -> str | None:
        return "\n".join(bare(c) if c.startswith("/**") else c[3:].removeprefix(" ") for c in comments).strip() or None

    def visible(self, i: int) -> tuple[str, int]:
        if not self.t.is_(i, "pub"):
            return "private", i
        return "public", self.t.after(i + 1) if self.t.is_(i + 1, "(") else i + 1

    def kinds(self, i: int) -> tuple[list[str], int]:
        t = self.t
        if not t.is_(i, "<"):
            return [], i
        j = t.angles(i)
        return [t.cut(a, b) for a, b in t.split(i + 1, j - 1) if not t.is_(a, "const") and not any(t.is_(k, "=") for k in range(a, b))], j

    def until(self, i: int, *stops: str) -> int:
        t = self.t
        while i < t.n and not t.is_(i, *stops):
            i = t.after(i) if t.is_(i, "(", "[", "{") else t.angles(i) if t.is_(i, "<") else i + 1
        return i

    def fn(self, i: int, marks) -> tuple[dict | None, int]:
        """The function at i, its visibility first."""
        t = self.t
        visibility, k = self.visible(i)
        words = set()
        while t.is_(k, *BEFORE_FN) or k < t.n and t.kind[k] == "string":
            words.add(t.text[k])
            k += 1
        if not t.is_(k, "fn") or not t.word(k + 1):
            return None, i
        name = t.text[k + 1]
        kinds, j = self.kinds(k + 2)
        if not t.is_(j, "("):
            return None, i
        found = []
        for a, b in t.split(j + 1, t.after(j) - 1):
            _, a = self.attributes(a)
            colon = self.until(a, ":")
            if any(t.is_(x, "self") for x in range(a, min(b, colon))):
                continue
            found.append(parameter(t.cut(a, min(colon, b)) or "_", t.cut(colon + 1, b) if colon < b else None))
        j, back = t.after(j), None
        if t.is_(j, "->"):
            end = self.until(j + 1, "{", ";", "where")
            back, j = t.cut(j + 1, end), end
        j = self.until(j, "{", ";")
        end = t.after(j) if t.is_(j, "{") else j + 1
        extra = ["unsafe"] if "unsafe" in words else []
        return function(name, t.line(i), t.last_line(end - 1), found, back, kinds, "async" in words, False, visibility, self.decorators(marks, i) + extra, self.said(marks, i)), end

    def functions(self, i: int, end: int) -> list[dict]:
        t, out = self.t, []
        while i < end:
            marks, i = self.attributes(i)
            made, j = self.fn(i, marks)
            if made:
                out.append(made)
            else:
                j = self.until(i, ";", "{")
                j = t.after(j) if t.is_(j, "{") else j + 1
            i = max(j, i + 1)
        return out

    def run(self) -> dict:
        t, out, i, impls = self.t, self.out, 0, []
        while i < t.n:
            marks, i = self.attributes(i)
            made, j = self.fn(i, marks)
            if made:
                out["functions"].append(made)
                i = j
                continue
            visibility, k = self.visible(i)
            k += t.is_(k, "unsafe") and t.is_(k + 1, "trait", "impl")
            if t.is_(k, "impl"):
                impls.append(k)
            end = self.until(k, ";", "{")
            if t.is_(k, "use"):
                end = self.until(k, ";")
                self.use(i, k + 1, end, visibility)
            elif t.is_(k, "const", "static") and not t.is_(k + 1, "{"):
                end = self.until(k, ";")
                self.constant(i, k, end, visibility, marks)
            elif t.is_(k, "struct", "enum", "trait") and t.word(k + 1):
                end = self.klass(i, k, end, visibility, marks)
                i = end
                continue
            i = max(t.after(end) if t.is_(end, "{") else end + 1, i + 1)
        for k in impls:
            self.implementation(k)
        for f in out["functions"]:
            if f["visibility"] == "public":
                out["exports"].append(exported(f["name"], "function", f["line"]))
        known = {(e["name"], e["line"]) for e in out["exports"]}
        out["exports"] += [exported(c["name"], "class", c["line"]) for c in out["classes"] if c["visibility"] == "public" and (c["name"], c["line"]) not in known]
        out["exports"] += [exported(c["name"], "variable", c["line"]) for c in out["constants"] if c["is_exported"]]
        return out

    def klass(self, i: int, k: int, end: int, visibility: str, marks) -> int:
        t, kind, name = self.t, self.t.text[k], self.t.text[k + 1]
        kinds, j = self.kinds(k + 2)
        body = t.is_(end, "{")
        stop = t.after(end) if body else end + 1
        extends, fields, methods = [], [], []
        if kind == "trait":
            if t.is_(j, ":"):
                bound = self.until(j + 1, "{", "where")
                extends = [t.cut(a, b) for a, b in t.split(j + 1, bound, "+")]
            methods = self.functions(end + 1, stop - 1) if body else []
        elif body:
            for a, b in t.split(end + 1, stop - 1):
                _, a = self.attributes(a)
                seen, n = self.visible(a)
                if kind == "enum":
                    fields.append(field(t.text[a], t.cut(a + 1, t.after(a + 1)) if t.is_(a + 1, "(", "{") else None))
                elif t.is_(n + 1, ":"):
                    fields.append(field(t.text[n], t.cut(n + 2, b), seen))
        made = klass(name, t.line(i), t.last_line(stop - 1), kinds, extends, (), fields, methods, self.decorators(marks, i), self.said(marks, i), visibility)
        self.out["classes"].append(made)
        self.types[name] = made
        if kind == "enum" and visibility == "public":
            self.out["exports"].append(exported(name, "enum", t.line(i)))
        return stop

    def implementation(self, k: int) -> None:
        t = self.t
        _, a = self.kinds(k + 1)
        body = self.until(a, "{", ";")
        stop = self.until(a, "{", ";", "where")
        split = self.until(a, "for", "{", ";", "where")
        trait, name = (t.cut(a, split), t.cut(split + 1, stop)) if t.is_(split, "for") else (None, t.cut(a, stop))
        methods = self.functions(body + 1, t.after(body) - 1) if t.is_(body, "{") else []
        target = self.types.get(name)
        if target is None:
            self.out["functions"] += methods
            return
        target["methods"] += methods
        if trait and trait not in target["implements"]:
            target["implements"].append(trait)

    def leaves(self, a: int, b: int, prefix: str):
        """(path, name, alias) of each leaf of a use tree."""
        t = self.t
        brace = next((k for k in range(a, b) if t.is_(k, "{")), None)
        if brace is not None:
            scope = re.sub(r"::$", "", t.cut(a, brace))
            inner = "::".join(x for x in (prefix, scope) if x)
            for x, y in t.split(brace + 1, t.after(brace) - 1):
                yield from self.leaves(x, y, inner)
        elif t.is_(b - 1, "*"):
            path = re.sub(r"::?$", "", t.cut(a, b - 1))
            yield "::".join(x for x in (prefix, path) if x) if not prefix or path else f"{prefix}::", "*", None
        else:
            alias = t.text[b - 1] if b - a > 2 and t.is_(b - 2, "as") else None
            whole = t.cut(a, b - 2 if alias else b)
            if whole in ("self", "super", "crate") and not alias:
                yield prefix or whole, whole, None
                return
            *scope, name = whole.split("::")
            path = f"{prefix}::{'::'.join(scope)}" if prefix else "::".join(scope)
            yield path or whole, name, alias

    def use(self, i: int, a: int, b: int, visibility: str) -> None:
        line = self.t.line(i)
        for path, name, alias in self.leaves(a, b, ""):
            self.out["imports"].append(imported(path, [specifier(name, alias, False, name == "*")], line))
            if visibility == "public":
                self.out["re_exports"].append(exported(alias or name, "re-export", line, path))

    def constant(self, i: int, k: int, end: int, visibility: str, marks) -> None:
        t = self.t
        k += 1 + t.is_(k + 1, "mut")
        if not t.word(k) and not t.is_(k, "_"):
            return
        eq = next((j for j in range(k, end) if t.is_(j, "=")), end)
        kind = t.cut(k + 2, eq) if t.is_(k + 1, ":") else None
        self.out["constants"].append(constant(t.text[k], t.line(i), kind, t.cut(eq + 1, end)[:100] if eq < end else None, visibility == "public", self.said(marks, i)))


def extract(source: str, language: str = "rust") -> dict:
    return Rust(source).run()
