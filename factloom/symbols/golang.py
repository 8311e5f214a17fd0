"""Symbols of Go."""

from __future__ import annotations

from factloom.symbols.tokens import GO, Tokens, constant, empty, exported, field, function, imported, klass, parameter, specifier


def public(name: str) -> bool:
    return "A" <= name[:1] <= "Z"


def seen(name: str) -> str:
    return "public" if public(name) else "private"


class Go:
    def __init__(self, source: str):
        self.t, self.out, self.types, self.loose = Tokens(source, GO), empty(), {}, []

    def said(self, i: int) -> str | None:
        """The comments above token i, up to a blank line; those that follow code on its line are among them."""
        lines, below = [], self.t.line(i)
        for text, first, last in reversed(self.t.comments_before(i)):
            if below - last > 1:
                break
            lines.insert(0, text[2:].removeprefix(" ") if text.startswith("//") else text[2:].removesuffix("*/").strip())
            below = first
        return "\n".join(lines).strip() or None

    def line_end(self, i: int, stop: int) -> int:
        """Behind the tokens that share a logical line with token i."""
        t = self.t
        while i < stop:
            if t.is_(i, ";"):
                return i
            i = t.after(i) if t.is_(i, "(", "[", "{") and t.kind[i] == "mark" else i + 1
            if i < stop and t.line(i) > t.last_line(i - 1) and not (t.kind[i - 1] == "mark" and t.text[i - 1] in ",.+-*/%=&|<>!^(:"):
                return i
        return i

    def lines(self, i: int, stop: int):
        while i < stop:
            j = self.line_end(i, stop)
            if j > i:
                yield i, j
            i = j + self.t.is_(j, ";") if j > i else i + 1

    def parts(self, i: int, j: int) -> list[tuple[int, int]]:
        """Between the commas; generic types have square brackets."""
        t, out, begin, k = self.t, [], i, i
        while k < j:
            if t.is_(k, "(", "[", "{"):
                k = t.after(k)
                continue
            if t.is_(k, ","):
                out.append((begin, k))
                begin = k + 1
            k += 1
        return [(a, b) for a, b in [*out, (begin, j)] if a < b]

    def parameters(self, i: int) -> list[dict]:
        """Of the parenthesis that opens at i."""
        t, parts = self.t, self.parts(i + 1, self.t.after(i) - 1)
        named = any(t.word(a) and b - a > 1 and not t.is_(a + 1, ".") and t.text[a] not in ("chan", "func", "map", "struct", "interface") for a, b in parts)
        out, waiting = [], []
        for a, b in parts:
            if named and b - a == 1:
                waiting.append(t.text[a])
                continue
            name, k = (t.text[a], a + 1) if named else ("_", a)
            rest, kind = t.is_(k, "..."), t.cut(k, b)
            out += [parameter(n, kind, None, rest) for n in [*waiting, name]]
            waiting = []
        return out

    def signature(self, i: int) -> tuple[dict, int]:
        """Type parameters, parameters and result from i on, and the token behind them."""
        t, kinds = self.t, []
        if t.is_(i, "["):
            group = []
            for a, b in self.parts(i + 1, t.after(i) - 1):
                group.append((a, b))
                if b - a > 1:
                    kinds.append(t.cut(group[0][0], b))
                    group = []
            i = t.after(i)
        found = self.parameters(i) if t.is_(i, "(") else []
        j = k = t.after(i) if t.is_(i, "(") else i
        while k < t.n and t.line(k) == t.last_line(k - 1) and not t.is_(k, ";", "}", ")"):
            if t.is_(k, "{") and t.text[k - 1] not in ("struct", "interface"):
                break
            k = t.after(k) if t.is_(k, "(", "[", "{") else k + 1
        return {"type_parameters": kinds, "parameters": found, "return_type": t.cut(j, k) or None}, k

    def run(self) -> dict:
        t, i = self.t, 0
        while i < t.n:
            word = t.text[i]
            j = self.line_end(i, t.n)
            if word == "func":
                j = max(j, self.func(i))
            elif word in ("type", "import", "const", "var"):
                for a, b in self.lines(i + 2, t.after(i + 1) - 1) if t.is_(i + 1, "(") else [(i + 1, j)]:
                    {"type": self.type, "import": self.imports, "const": self.const, "var": self.var}[word](a, b, i)
            i = max(j, i + 1)
        for base, f in self.loose:
            (self.types[base]["methods"] if base in self.types else self.out["functions"]).append(f)
        out = self.out
        for f in out["functions"]:
            if f["visibility"] == "public":
                out["exports"].append(exported(f["name"], "function", f["line"]))
        for c in out["classes"]:
            if c["visibility"] == "public":
                out["exports"].append(exported(c["name"], "class", c["line"]))
        out["exports"] += [exported(c["name"], "variable", c["line"]) for c in out["constants"]]
        return out

    def func(self, i: int) -> int:
        t, k, base = self.t, i + 1, None
        if t.is_(k, "("):
            named = self.parameters(k)
            base = (named[0]["type"] or "").removeprefix("*") if named else ""
            k = t.after(k)
        if not t.word(k):
            return k
        name = t.text[k]
        facts, j = self.signature(k + 1)
        end = t.after(j) if t.is_(j, "{") else j
        made = function(name, t.line(i), t.last_line(end - 1), visibility=seen(name), docstring=self.said(i), **facts)
        if base is None:
            self.out["functions"].append(made)
        else:
            self.loose.append((base, made))
        return end

    def type(self, a: int, b: int, first: int) -> None:
        t, name, k, kinds = self.t, self.t.text[a], a + 1, []
        if t.is_(k, "["):
            parts = self.parts(k + 1, t.after(k) - 1)
            if parts and any(y - x > 1 for x, y in parts):  # else the length of an array
                kinds, k = [t.cut(x, y) for x, y in parts], t.after(k)
        if t.is_(k, "="):
            return
        said = self.said(first) or self.said(a)
        if t.is_(k, "struct", "interface") and t.is_(k + 1, "{"):
            end = t.after(k + 1)
            read = self.struct if t.text[k] == "struct" else self.interface
            extends, fields, methods = read(k + 2, end - 1)
            made = klass(name, t.line(a), t.last_line(end - 1), kinds, extends, (), fields, methods, (), said, seen(name))
            self.out["classes"].append(made)
            self.types[name] = made
        elif public(name):
            self.out["exports"].append(exported(name, "type", t.line(a), None, True))

    def struct(self, i: int, end: int):
        t, extends, fields = self.t, [], []
        for a, b in self.lines(i, end):
            tag = t.text[b - 1] if t.kind[b - 1] == "string" else None
            stop = b - (tag is not None)
            names, k = [t.text[a]], a + 1
            while t.is_(k, ",") and k + 1 < stop:
                names.append(t.text[k + 1])
                k += 2
            if k >= stop or t.is_(a, "*") or t.is_(k, ".") or t.is_(k, "[") and t.after(k) >= stop and not t.word(t.after(k)) and t.line(k) == t.line(a) and t.start[k] == t.end[a]:
                extends.append(t.cut(a, stop).removeprefix("*"))
                continue
            fields += [field(n, t.cut(k, stop), seen(n)) for n in names]
            if tag and tag.startswith("`"):
                fields[-1]["type"] = f"{fields[-1]['type']} {tag}"
        return extends, fields, []

    def interface(self, i: int, end: int):
        t, extends, methods = self.t, [], []
        for a, b in self.lines(i, end):
            if t.word(a) and t.is_(a + 1, "("):
                facts, _ = self.signature(a + 1)
                methods.append(function(t.text[a], t.line(a), t.last_line(b - 1), docstring=self.said(a), **facts))
            elif b - a == 1 or b - a == 3 and t.is_(a + 1, "."):
                extends.append(t.cut(a, b))
        return extends, [], methods

    def imports(self, a: int, b: int, first: int) -> None:
        t = self.t
        if t.kind[b - 1] != "string":
            return
        path, alias = t.text[b - 1][1:-1], t.text[a] if b - a > 1 else None
        name = alias if alias in ("_", ".") else path.split("/")[-1]
        line = t.line(first) if a == first + 1 else t.line(a)
        self.out["imports"].append(imported(path, [specifier(name, None if alias in ("_", ".") else alias, False, alias == ".")], line))

    def values(self, a: int, b: int, iota: bool) -> None:
        t, names, k = self.t, [self.t.text[a]], a + 1
        while t.is_(k, ",") and k + 1 < b:
            names.append(t.text[k + 1])
            k += 2
        eq = next((j for j in range(k, b) if t.is_(j, "=")), b)
        kind, said = t.cut(k, eq) or None, self.said(a)
        value = "iota" if iota and "iota" in t.cut(eq + 1, b) else None
        self.out["constants"] += [constant(n, t.line(a), kind, value, True, said) for n in names if public(n)]

    def const(self, a: int, b: int, first: int) -> None:
        self.values(a, b, True)

    def var(self, a: int, b: int, first: int) -> None:
        self.values(a, b, False)



def extract(source: str, language: str = "go") -> dict:
    return Go(source).run()
