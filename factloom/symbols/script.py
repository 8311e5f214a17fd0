"""Symbols of TypeScript and JavaScript."""

from __future__ import annotations

from factloom.symbols.tokens import SCRIPT, Tokens, constant, empty, exported, field, function, imported, klass, parameter, short, specifier

MODIFIERS = frozenset("public private protected static abstract override readonly async get set declare accessor".split())
#: A new line before a token ends a statement unless the token before it or itself is one of these.
GOES_ON = frozenset(", . ?. + - * / % = => : ? ?? && || & | ^ < ! ~ ( [ { ...".split()) | frozenset("as satisfies instanceof in of extends implements is keyof typeof new return".split())
CONTINUES = frozenset(", . ?. + - * / % = => : ? ?? && || & | ^ < > ( [ ) ] } ;".split()) | frozenset("as satisfies instanceof in of extends implements is else catch finally while".split())
#: After these, an opening brace is an object type and no body.
TYPE_GOES_ON = frozenset(": | & => < , ( [ ? extends is keyof typeof readonly asserts =".split())
JSX_BEFORE = frozenset("( => , ? : && || { = [ } > ;".split()) | {"return"}


class Script:
    def __init__(self, source: str, javascript: bool = False, jsx: bool = False):
        self.t, self.out, self.js, self.jsx = Tokens(source, SCRIPT, script=True), empty(), javascript, jsx

    def run(self) -> dict:
        i = 0
        while i < self.t.n:
            i = max(i + 1, self.statement(i))
        return self.out

    # -- statements ---------------------------------------------------------

    def decorators(self, i: int) -> tuple[list[str], int]:
        t, out = self.t, []
        while t.is_(i, "@"):
            j = i + 2
            while t.is_(j, "."):
                j += 2
            if t.is_(j, "(") and t.start[j] == t.end[j - 1]:
                j = t.after(j)
            out.append(t.cut(i, j))
            i = j
        return out, i

    def statement(self, start: int) -> int:
        t = self.t
        decorators, i = self.decorators(start)
        if t.is_(i, "import") and not t.is_(i + 1, "(", "."):
            return self.imports(i)
        if t.is_(i, "export"):
            return self.exports(i, start, decorators)
        return self.declaration(i, start, None, []) or self.skip(i)

    def skip(self, i: int) -> int:
        """Behind the statement that begins at i."""
        t = self.t
        while i < t.n:
            x = t.text[i]
            if x == ";":
                return i + 1
            block = x == "{"
            i = t.after(i) if t.kind[i] == "mark" and x in ("(", "[", "{") else i + 1
            if i < t.n and t.line(i) > t.last_line(i - 1) and (t.text[i - 1] not in GOES_ON or block) and t.text[i] not in CONTINUES:
                return i
            if block and i < t.n and t.word(i) and t.text[i] not in CONTINUES:
                return i
        return i

    def value_end(self, i: int) -> int:
        """Behind the expression that begins at i: at a comma, a semicolon or the end of its statement."""
        t = self.t
        while i < t.n:
            x = t.text[i]
            if x in (",", ";"):
                return i
            if t.kind[i] == "mark" and x in (")", "]", "}"):
                return i
            i = t.after(i) if t.kind[i] == "mark" and x in ("(", "[", "{") else i + 1
            if i < t.n and t.line(i) > t.last_line(i - 1) and (t.text[i - 1] not in GOES_ON or t.kind[i - 1] == "string") and t.text[i] not in CONTINUES:
                return i
        return i

    def type_end(self, i: int, *stops: str) -> int:
        """Behind the type that begins at i: at a stop, at a body's brace or where its line ends it."""
        t, before, takes = self.t, ":", False
        while i < t.n:
            x, mark = t.text[i], t.kind[i] == "mark"
            if mark and x in stops or mark and x in (")", "]", "}", ";"):
                return i
            if mark and (x == "{" and before not in TYPE_GOES_ON or x == "=>" and not (before == ")" and takes)):
                return i
            if before not in TYPE_GOES_ON and t.line(i) > t.last_line(i - 1) and x not in ("|", "&", "=>", "?", ":", "extends", "is"):
                return i
            if mark and x in ("(", "[", "{"):
                takes = x == "(" and (t.is_(i + 1, ")", "...", "{", "[") or t.word(i + 1) and (t.is_(i + 2, ":", ",", "?", "=") or t.is_(i + 2, ")") and t.is_(i + 3, "=>")))
                i = t.after(i)
                before = ")"
                continue
            if mark and x == "<":
                i = t.angles(i)
                before = ">"
                continue
            before, i = x, i + 1
        return i

    def annotation(self, i: int, *stops: str) -> tuple[str | None, int]:
        if not self.t.is_(i, ":"):
            return None, i
        j = self.type_end(i + 1, *stops)
        return self.t.cut(i + 1, j), j

    def type_parameters(self, i: int) -> tuple[list[str], int]:
        if not self.t.is_(i, "<"):
            return [], i
        j = self.t.angles(i)
        return [self.t.cut(a, b) for a, b in self.t.split(i + 1, j - 1)], j

    # -- functions ----------------------------------------------------------

    def parameters(self, i: int) -> list[dict]:
        """Of the parenthesis that opens at i."""
        t, out, k, end = self.t, [], i + 1, min(self.t.close.get(i, self.t.n), self.t.n)
        while k < end:
            _, k = self.decorators(k)
            while t.is_(k, "public", "private", "protected", "readonly", "override") and k + 1 < end and (t.word(k + 1) or t.is_(k + 1, "{", "[")):
                k += 1
            rest = t.is_(k, "...")
            a = k + rest
            b = t.after(a) if t.is_(a, "{", "[") else a + 1
            k = b + t.is_(b, "?")
            kind, k = self.annotation(k, ",", "=")
            default = None
            if t.is_(k, "="):
                j = k + 1
                while j < end and not t.is_(j, ","):
                    j = t.after(j) if t.is_(j, "(", "[", "{") and t.kind[j] == "mark" else j + 1
                default, k = t.cut(k + 1, j), j
            if a < end:
                if not self.js:
                    out.append(parameter(t.cut(a - rest, b), kind, default, rest))
                elif rest or default is None and t.word(a):
                    out.append(parameter(t.cut(a, b), None, None, rest))
            k = max(k, b)
            while k < end and not t.is_(k, ","):
                k += 1
            k += 1
        return out

    def signature(self, i: int) -> tuple[dict, int] | None:
        """Type parameters, parameters and return type from i on, and the token behind them."""
        kinds, i = self.type_parameters(i)
        if not self.t.is_(i, "("):
            return None
        found, j = self.parameters(i), self.t.after(i)
        back, j = self.annotation(j, ",", "=")
        return {"type_parameters": kinds, "parameters": found, "return_type": back}, j

    def shows_jsx(self, i: int, j: int) -> bool:
        t = self.t
        return self.jsx and any(t.text[k] == "<" and t.kind[k] == "mark" and (t.word(k + 1) or t.is_(k + 1, ">")) and t.text[k - 1] in JSX_BEFORE for k in range(max(i, 1), min(j, t.n - 1)))

    def function_value(self, i: int, end: int):
        """(facts of a function expression, its body's tokens) if tokens i to end - 1 are one, else None."""
        t, facts = self.t, {"is_async": False, "is_generator": False}
        if t.is_(i, "async") and not t.is_(i + 1, "=>"):
            facts["is_async"], i = True, i + 1
        if t.is_(i, "function"):
            i += 1
            facts["is_generator"] = t.is_(i, "*")
            i += t.is_(i, "*")
            i += t.word(i)
            got = self.signature(i)
            if got and t.is_(got[1], "{") and t.after(got[1]) >= end:
                return facts | got[0], (got[1], t.after(got[1]))
            return None
        if t.word(i) and t.is_(i + 1, "=>"):
            return facts | {"parameters": [], "type_parameters": [], "return_type": None}, (i + 2, end)
        got = self.signature(i)
        if got and t.is_(got[1], "=>"):
            return facts | got[0], (got[1] + 1, end)
        return None

    # -- declarations -------------------------------------------------------

    def declaration(self, i: int, start: int, export: str | None, decorators: list[str]) -> int:
        """Reads the declaration at i, of a statement that begins at start; export: None, 'named' or 'default'. 0 if there is none."""
        t, out = self.t, self.out
        line = t.line(i)
        add = lambda name, kind, type_only=False: out["exports"].append(exported("default" if export == "default" else name, "default" if export == "default" else kind, line, None, type_only))
        k = i + t.is_(i, "async")
        if t.is_(k, "function"):
            k += 1
            generator = t.is_(k, "*")
            k += generator
            if not t.word(k):
                return 0
            name, got = t.text[k], self.signature(k + 1)
            if not got:
                return 0
            facts, j = got
            if not t.is_(j, "{"):
                return self.skip(i)  # a signature without a body is no function
            body = j, t.after(j)
            marks = ["@component"] if export and self.shows_jsx(*body) else []
            out["functions"].append(function(name, line, t.last_line(body[1] - 1), is_async=t.is_(i, "async"), is_generator=generator, decorators=marks, docstring=t.said_above(i) or (t.said_above(start) if export else None), **facts))
            if export:
                add(name, "function")
            return body[1]
        k = i + t.is_(i, "abstract")
        if t.is_(k, "class") and t.word(k + 1) and not t.is_(k + 1, "extends", "implements"):
            first = i if export else start  # decorators belong to a class that is not exported, and stand before one that is
            end = self.klass(k, first, start, decorators if export else [])
            if export:
                add(t.text[k + 1], "class")
            return end
        if t.is_(i, "interface") and t.word(i + 1):
            end = self.interface(i, start)
            if export:
                out["exports"].append(exported(t.text[i + 1], "interface", line, None, True))
            return end
        k = i + t.is_(i, "const")
        if t.is_(k, "enum") and t.word(k + 1):
            if export:
                out["exports"].append(exported(t.text[k + 1], "enum", line))
            return t.after(k + 2) if t.is_(k + 2, "{") else self.skip(i)
        if t.is_(i, "type") and t.word(i + 1) and t.is_(i + 2, "=", "<"):
            if export:
                out["exports"].append(exported(t.text[i + 1], "type", line))
            return self.skip(i)
        if t.is_(i, "const", "let", "var") and (t.word(i + 1) or t.is_(i + 1, "{", "[")):
            return self.variables(i, export)
        return 0

    def variables(self, i: int, export: str | None) -> int:
        t, out, k, line = self.t, self.out, i + 1, self.t.line(i)
        found = []
        while k < t.n:
            name = k
            k = t.after(k) if t.is_(k, "{", "[") else k + 1
            label = t.cut(name, k)
            k += t.is_(k, "!")
            kind, k = self.annotation(k, ",", "=")
            value = None
            if t.is_(k, "="):
                j = self.value_end(k + 1)
                value, k = (k + 1, j), j
            found.append((label, kind, value))
            if not t.is_(k, ","):
                break
            k += 1
        last = t.last_line(k - 1 + t.is_(k, ";"))
        said = t.said_above(i) if not export else None
        for label, kind, value in found:
            made = self.function_value(*value) if value else None
            if made:
                facts, body = made
                out["functions"].append(function(label, line, last, decorators=["@component"] if self.shows_jsx(*body) else [], docstring=said, **facts))
                if export:
                    out["exports"].append(exported(label, "function", line))
            elif export and t.is_(i, "const"):
                out["constants"].append(constant(label, line, kind, short(t.cut(*value)) if value else None, True, said))
                out["exports"].append(exported(label, "variable", line))
        return k + t.is_(k, ";")

    def klass(self, k: int, first: int, start: int, decorators: list[str]) -> int:
        t = self.t
        name, j = t.text[k + 1], k + 2
        kinds, j = self.type_parameters(j)
        extends, implements = [], []
        while j < t.n and not t.is_(j, "{"):
            into = extends if t.is_(j, "extends") else implements
            a = j = j + 1
            while j < t.n and not t.is_(j, "{", "extends", "implements"):
                j = t.after(j) if t.is_(j, "(", "[") else t.angles(j) if t.is_(j, "<") else j + 1
            for x, y in t.split(a, j):
                z = x
                while into is extends and z < y and not t.is_(z, "<"):
                    z = t.after(z) if t.is_(z, "(", "[") else z + 1
                into.append(t.cut(x, z if into is extends else y))
        end = t.after(j)
        fields, methods = self.members(j + 1, end - 1)
        extends, implements, fields = ([], [], []) if self.js else (extends, implements, fields)
        self.out["classes"].append(klass(name, t.line(first), t.last_line(end - 1), kinds, extends, implements, fields, methods, decorators, t.said_above(first) or t.said_above(start)))
        return end

    def name_end(self, i: int) -> int:
        return self.t.after(i) if self.t.is_(i, "[") else i + 1

    def members(self, i: int, end: int) -> tuple[list[dict], list[dict]]:
        t, fields, methods = self.t, [], []
        while i < end:
            if t.is_(i, ";"):
                i += 1
                continue
            marks, i = self.decorators(i)
            first, words = i, set()
            while t.is_(i, *MODIFIERS) and i + 1 < end and not t.is_(i + 1, "(", "=", ":", ";", "?", "!", "<", "}", ","):
                if t.text[i] == "static" and t.is_(i + 1, "{"):
                    break
                if t.line(i + 1) > t.line(i) and not t.word(i + 1) and not t.is_(i + 1, "[", "*"):
                    break
                words.add(t.text[i])
                i += 1
            if t.is_(i, "static") and t.is_(i + 1, "{"):
                i = t.after(i + 1)
                continue
            i += t.is_(i, "*")
            if i >= end:
                break
            a, b = i, self.name_end(i)
            computed = t.is_(a, "[") and t.is_(a + 2, ":", "in")
            name = t.cut(a, b)
            j = b + t.is_(b, "?", "!")
            seen = "private" if "private" in words or name.startswith("#") else "protected" if "protected" in words else "public"
            got = self.signature(j) if t.is_(j, "(", "<") else None
            if got:
                facts, j = got
                if t.is_(j, "{"):
                    j = t.after(j)
                    word = "get " if "get" in words else "set " if "set" in words else ""
                    extra = [f"@{w}" for w in ("static", "abstract", "override") if w in words]
                    methods.append(function(word + name, t.line(first), t.last_line(j - 1), is_async="async" in words, visibility=seen, decorators=marks + extra, docstring=None if marks else t.said_above(first), **facts))
                i = max(j, b)
                continue
            kind, j = self.annotation(j, "=", ",")
            if t.is_(j, "="):
                j = self.value_end(j + 1)
            if not computed:
                fields.append(field(name, kind, seen, "static" in words, "readonly" in words))
            i = max(j, b)
        return fields, methods

    def interface(self, i: int, start: int) -> int:
        t = self.t
        kinds, j = self.type_parameters(i + 2)
        extends = []
        if t.is_(j, "extends"):
            a = j = j + 1
            while j < t.n and not t.is_(j, "{"):
                j = t.angles(j) if t.is_(j, "<") else j + 1
            extends = [t.cut(x, y) for x, y in t.split(a, j)]
        end, fields, methods, k = t.after(j), [], [], j + 1
        while k < end - 1:
            first = k
            if t.is_(k, ";", ","):
                k += 1
                continue
            words = set()
            while t.is_(k, "readonly", "get", "set") and not t.is_(k + 1, "(", ":", "?", "<", ";", ","):
                words.add(t.text[k])
                k += 1
            if t.is_(k, "(", "<") or t.is_(k, "new") and t.is_(k + 1, "(", "<"):  # call and construct signatures
                k = self.type_end(k + t.is_(k, "new"), ",")
                k = self.type_end(k + 1, ",") if t.is_(k, ":") else k
                continue
            a, b = k, self.name_end(k)
            k = b + t.is_(b, "?")
            got = self.signature(k) if t.is_(k, "(", "<") else None
            if got:
                facts, k = got
                methods.append(function(t.cut(a, b), t.line(first), t.last_line(k - 1), **facts))
                continue
            kind, k = self.annotation(k, ",")
            if not (t.is_(a, "[") and t.is_(a + 2, ":", "in")):
                fields.append(field(t.cut(a, b), kind, is_readonly="readonly" in words))
            k = max(k, b)
        self.out["classes"].append(klass(t.text[i + 1], t.line(i), t.last_line(end - 1), kinds, extends, (), fields, methods, (), t.said_above(i) or t.said_above(start)))
        return end

    # -- imports and exports ------------------------------------------------

    def path(self, i: int) -> str:
        return self.t.text[i][1:-1]

    def imports(self, i: int) -> int:
        t, k, names = self.t, i + 1, []
        type_only = t.is_(k, "type") and not t.is_(k + 1, "from", ",")
        k += type_only
        while k < t.n and t.kind[k] != "string" and not t.is_(k, ";"):
            if t.is_(k, "{"):
                for a, b in t.split(k + 1, t.after(k) - 1):
                    a += t.is_(a, "type") and b - a > 1 and not t.is_(a + 1, "as")
                    names.append(specifier(t.text[a], t.text[a + 2] if b - a > 2 else None))
                k = t.after(k)
            elif t.is_(k, "*"):
                names.append(specifier(t.text[k + 2] if t.is_(k + 1, "as") else "*", None, False, True))
                k += 3
            elif t.word(k) and not t.is_(k, "from") or t.is_(k, "from") and t.is_(k + 1, "from", ","):
                names.append(specifier(t.text[k], None, True))
                k += 1
            else:
                k += 1
        if k < t.n and t.kind[k] == "string":
            self.out["imports"].append(imported(self.path(k), names, t.line(i), type_only))
            return self.skip(k)
        return self.skip(i)

    def exports(self, i: int, start: int, decorators: list[str]) -> int:
        t, out, line, k = self.t, self.out, self.t.line(start), i + 1
        type_only = t.is_(k, "type") and t.is_(k + 1, "{", "*")
        k += type_only
        if t.is_(k, "*"):
            name, j = ("*", k + 1) if not t.is_(k + 1, "as") else (t.text[k + 2], k + 3)
            if t.is_(j, "from"):
                one = exported(name, "namespace", line, self.path(j + 1), type_only)
                out["exports"].append(one)
                out["re_exports"].append(one)
            return self.skip(k + 1)
        if t.is_(k, "{"):
            j = t.after(k)
            source = self.path(j + 1) if t.is_(j, "from") and j + 1 < t.n else None
            for a, b in t.split(k + 1, j - 1):
                a += t.is_(a, "type") and b - a > 1 and not t.is_(a + 1, "as")
                one = exported(t.text[a + 2] if b - a > 2 else t.text[a], "re-export" if source is not None else "variable", line, source, type_only)
                out["exports"].append(one)
                if source is not None:
                    out["re_exports"].append(one)
            return self.skip(k)
        default = t.is_(k, "default")
        more, k = self.decorators(k + default)
        if t.is_(k, "declare", "import", "=", "as", "namespace", "module") and not default:
            return self.skip(i)
        end = self.declaration(k, start, "default" if default else "named", decorators + more)
        if not end and default:
            out["exports"].append(exported("default", "default", line))
        return end or self.skip(k)


def extract(source: str, language: str) -> dict:
    return Script(source, language == "javascript", language != "typescript").run()
