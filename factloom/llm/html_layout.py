"""HTML extraction by layout-aware rendering.

A tree builder with the implied end tags of HTML keeps the open elements and, for each tag, where it is open, so that no
search walks the tree. Text and breaks go into one stream for each box that needs its own layout (table cells, captions and
preformatted text); lists, quotes and definitions only open and close an indent in it. What is not displayed is left out,
by element, attribute, style and the page's own style rules; visibility can be given back to what lies inside hidden
elements. Of rules those count whose selector is one of tag, classes and id together, outside at-rules; others, scripts and
sheets of other files do not. Blocks begin on new
lines, paragraphs and headings are set off by an empty line, list items have bullets or their numbers, and the cells of a
table are aligned in columns, also below cells that span rows or columns; wide characters count two columns, combining ones
none. A cell spans 1,000 columns and 65,534 rows at
most, as in HTML. Two bounds keep hostile pages from growing as their square, and neither loses text: indents grow no more
beyond 512 levels, and a table that alignment would make longer than 64 times its text (and 1 MB) has ragged columns.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, small_batches

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)|<[!?/][^>]*+>?", re.S)
UNENDED = re.compile(r"<[!?/]|\Z")
NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(?:\s*+(=)\s*+)?")
BARE = re.compile(r"[^\s>]*+")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: An at-rule, which is passed over, or a rule's selectors and declarations.
CSS_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\}?)|(?P<of>[^{}@]+)\{(?P<says>[^{}]*)\}?")
SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I | re.A) for tag in RAW}
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object canvas audio video datalist title rp".split())
#: Elements that are not displayed inside these others.
UNSEEN_IN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset("annotation annotation-xml".split())}
#: Kinds of input that show no value.
NO_VALUE = frozenset("hidden password checkbox radio file image color range".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre listing plaintext xmp table figure fieldset menu".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center details dialog dir div dd dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption thead tbody tfoot".split())
CLOSES_P = (BLOCK | {"hr"}) - frozenset("html body tr caption thead tbody tfoot option optgroup".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open head takes in; any other start tag and any text but white space end it.
IN_HEAD = frozenset("base link meta noframes noscript script style template title".split())
#: Start tag: elements that it ends, and those at which the search for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}), "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}), "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
#: An end tag of another element does not reach beyond these.
SCOPE = frozenset("table td th caption template".split())
#: End tags that reach out of cells.
OF_TABLE = frozenset("table tr thead tbody tfoot body html".split())
LISTS = frozenset("ul ol menu dir".split())
PRE = frozenset("pre listing xmp plaintext".split())
#: Boxes with a layout of their own, and elements that indent.
COLLECTS, INDENTS = frozenset("td th caption option select".split()), {"li": 1, "blockquote": 2, "dd": 1}
DEEPEST = 512


class Lines(tuple):
    """Lines that are laid out already."""


class Open:
    """Begins an indent: its first line has the mark, the others as many spaces."""

    __slots__ = ("mark",)

    def __init__(self, mark: str):
        self.mark = mark


CLOSE = object()


def columns(text: str) -> int:
    """How many columns a line takes."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def declared(css: str) -> dict[str, tuple[str, bool]]:
    """Value of display, visibility and white-space, and whether it is important; of several the last that weighs most."""
    out: dict[str, tuple[str, bool]] = {}
    for name, value, strong in STYLE.findall(CSS_COMMENT.sub(" ", css) if "/*" in css else css):
        if strong or not out.get(name.lower(), ("", False))[1]:
            out[name.lower()] = value.lower(), bool(strong)
    return out


def rules_of(css: str) -> list[tuple]:
    """(tag, classes, ids, declarations) of each selector that names a tag, classes and ids of one element, in order."""
    out = []
    for m in CSS_RULE.finditer(CSS_COMMENT.sub(" ", css)):
        said = declared(m["says"]) if m["of"] else {}
        for one in m["of"].split(",") if said else ():
            if (part := SELECTOR.fullmatch(one.strip())) and part[0]:
                names = re.findall(r"([.#])([\w-]+)", part[2])
                out.append(((part[1] or "*").lower(), frozenset(n for k, n in names if k == "."), frozenset(n for k, n in names if k == "#"), said))
    return out


class Node:
    __slots__ = ("tag", "out", "seen", "vis", "pre", "info", "box")

    def __init__(self, tag, out, seen, vis, pre, info=None):
        self.tag, self.out, self.seen, self.vis, self.pre, self.info, self.box = tag, out, seen, vis, pre, info, False


def lay_out(items: list) -> list[str]:
    """Lines of text runs, line breaks (1: new line, 2: empty line before the next, 0: forced break), indents and laid out
    lines. An indent without a line leaves no mark."""
    lines: list[str] = []
    run: list[str] = []
    stack: list[tuple] = []
    base, first, gap = "", None, 0  # first: what the next line begins with instead of base, as (what was before, mark)

    def put(new) -> None:
        nonlocal gap, first
        if lines and gap == 2 and lines[-1] != "":
            lines.append("")
        gap = 0
        if first is not None and new:
            marks = []
            while isinstance(first, tuple):
                first, mark = first
                marks.append(mark)
            lines.append(first + "".join(reversed(marks)) + new[0])
            first, new = None, new[1:]
        lines.extend([base + x if x else "" for x in new] if base else new)

    def end() -> bool:
        if run:
            text = SPACES.sub(" ", "".join(run)).strip(" ")
            run.clear()
            if text:
                put([text])
                return True
        return False

    for x in items:
        if x.__class__ is str:
            run.append(x)
        elif x.__class__ is int:
            flushed = end()
            gap = max(gap, x or (1 if flushed else 2))
        elif x.__class__ is Open:
            end()
            stack.append((base, first, len(lines)))
            first = (base if first is None else first, x.mark)
            if len(stack) <= DEEPEST:
                base += " " * len(x.mark)
        elif x is CLOSE:
            end()
            base, before, n = stack.pop()
            first = before if len(lines) == n else None
        else:
            end()
            put(x)
    end()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def places(rows: list) -> list | None:
    """Rows of (column, columns spanned, lines) of rows of (columns spanned, rows spanned, lines): cells move beyond those
    that reach down to them. None if that takes too long."""
    out, until, work = [], {}, 1 << 20
    for r, row in enumerate(rows):
        c, cells = 0, []
        for span, down, lines in row:
            while until.get(c, -1) >= r:
                c, work = c + 1, work - 1
            cells.append((c, span, lines))
            if down != 1:
                for k in range(c, c + span):
                    until[k] = r + down - 1 if down else len(rows)
                work -= span
            c, work = c + span, work + 64
            if work < 0:
                return None
        out.append(cells)
    return out


def table_lines(rows: list) -> list[str]:
    """Rows of (columns spanned, rows spanned, lines) as text: columns as wide as their widest cell that spans no other, and
    the last that a cell spans wider if another cell follows it."""
    if all(len(row) < 2 for row in rows) and all(cell[1] == 1 for row in rows for cell in row):
        out: list[str] = []
        for row in rows:
            for _, _, cell in row:
                out.extend(cell)
        return out
    placed = places(rows)
    if placed is not None:
        width: dict[int, int] = {}
        for row in placed:
            for c, span, cell in row:
                if span == 1:
                    width[c] = max(width.get(c, 0), max(map(columns, cell), default=0))

        def offsets():
            at = sorted(width)
            total, sums = 0, [0]
            for c in at:
                total += width[c]
                sums.append(total)
            return lambda c: 3 * c + sums[bisect_left(at, c)]

        start, wider = offsets(), {}
        for row in placed:
            for c, span, cell in row[:-1]:
                if span > 1:
                    lack = max(map(columns, cell), default=0) - (start(c + span) - start(c) - 3)
                    wider[c + span - 1] = max(wider.get(c + span - 1, 0), lack)
        for c, lack in wider.items():
            width[c] = width.get(c, 0) + lack
        start = offsets()
        text = sum(len(x) for row in placed for _, _, cell in row for x in cell)
        if sum(start(row[-1][0]) * max(len(cell) for _, _, cell in row) for row in placed if row) > 64 * text + (1 << 20):
            placed = None
    out = []
    if placed is None:
        for row in rows:
            for k in range(max((len(cell) for _, _, cell in row), default=0)):
                out.append(" | ".join(cell[k] if k < len(cell) else "" for _, _, cell in row).rstrip())
        return out
    for row in placed:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            parts, at = [], 0
            for c, _, cell in row:
                x = cell[k] if k < len(cell) else ""
                if c:
                    parts += [" " * (start(c) - 3 - at), " | "]
                    at = max(at, start(c) - 3) + 3
                parts.append(x)
                at += columns(x)
            out.append("".join(parts).rstrip())
    return out


def roman(n: int) -> str:
    out = ""
    for v, r in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + r * (n // v), n % v
    return out


def letters(n: int) -> str:
    out = ""
    while n:
        out, n = chr(97 + (n - 1) % 26) + out, (n - 1) // 26
    return out


def ordinal(n: int, kind: str) -> str:
    """The mark of an item by the list's type; numbers that a type cannot write are decimal."""
    if kind in ("a", "A") and n > 0 or kind in ("i", "I") and 0 < n < 4000:
        s = letters(n) if kind in "aA" else roman(n)
        return f"{s.upper() if kind in 'AI' else s}. "
    return f"{n}. "


def number(value, least: int, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return max(least, int(m[1])) if m else default


def attributes(source: str, at: int, dead: set) -> tuple[dict, int]:
    """Attributes of the tag whose name ends at `at`, and where the tag ends; quoted values may have any length and hold '>'.

    A tag whose quotes do not close ends at the first '>', of which there must be one. dead: quotes from which no end is
    reached; they are kept for the page, so each is followed once.
    """
    found, begun, first = {}, [], at
    while at < len(source):
        if source[at] == ">":
            return found, at + 1
        m = NAME.match(source, at)
        name, value, at = m[1], "", m.end()
        if m[2]:
            quote = source[at : at + 1]
            if quote in ("'", '"'):
                stop = -1 if at in dead else source.find(quote, at + 1)
                begun.append(at)
                if stop < 0:
                    break
                value, at = source[at + 1 : stop], stop + 1
            else:
                value = BARE.match(source, at)[0]
                at += len(value)
        if name:
            found[name.lower()] = value
    dead.update(begun)
    stop = source.find(">", first)
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(source, first, stop)}, stop + 1


class Builder:
    def __init__(self, rules: list[tuple] = ()):
        self.rules: dict[tuple, list] = defaultdict(list)  # by what an element must have: an id, else a class, else its tag
        for n, rule in enumerate(rules):
            tag, classes, ids, _ = rule
            key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
            self.rules[key].append(((len(ids), len(classes), tag != "*", n), rule))
        self.found: list[tuple] = []  # rules that the page has
        self.top: list = []
        self.stack = [Node("#", self.top, True, True, False)]
        self.at: dict[str, list[int]] = defaultdict(list)  # where each tag is open
        self.title: list[str] = []

    def styles(self, tag: str, found: dict) -> dict[str, str]:
        """What rules and the element's own style say of it: important ones first, then its own, then the most specific."""
        said: dict[str, tuple] = {}
        if self.rules:
            classes, own = found.get("class", "").split(), found.get("id")
            for key in (("", "*"), ("", tag), *((".", c) for c in classes), ("#", own)):
                for weight, (of, all_, ids, says) in self.rules.get(key, ()):
                    if of in ("*", tag) and all_ <= set(classes) and ids <= {own}:
                        for name, (value, strong) in says.items():
                            said[name] = max(said.get(name, ((),)), ((strong, False, weight), value))
        if "style" in found:
            for name, (value, strong) in declared(entities.unescape(found["style"])).items():
                said[name] = max(said.get(name, ((),)), ((strong, True, ()), value))
        return {name: x[1] for name, x in said.items()}

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def text(self, s: str, raw: bool = False) -> None:
        if self.stack[-1].tag == "head" and (entities.unescape(s) if "&" in s else s).strip(" \t\n\r\f"):
            self.pop()
        node = self.stack[-1]
        if not s or node.tag in ("table", "thead", "tbody", "tfoot", "tr", "select") and not s.strip():
            return
        if node.seen and node.vis and node.info != "closed":
            s = entities.unescape(s) if "&" in s and not raw else s
            node.out.append(s.replace("\xa0", " ") if "\xa0" in s else s)

    def open(self, tag: str, found: dict) -> None:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.pop()
        if tag == "select" and self.at["select"]:  # ends the open one
            return self.end(tag)
        if tag in CLOSES_P:
            self.close_implied({"p"}, SCOPE)
        if tag in IMPLIED:
            self.close_implied(*IMPLIED[tag])
        parent = self.stack[-1]
        style = self.styles(tag, found) if self.rules or "style" in found else {}
        display, shown = style.get("display"), style.get("visibility", "inherit")
        vis = parent.vis if shown in ("inherit", "unset") else shown not in ("hidden", "collapse")
        seen = parent.seen and tag not in UNSEEN and (display != "none" if display else "hidden" not in found) and not (tag == "dialog" and "open" not in found)
        if seen and any(tag in tags and self.at[of] for of, tags in UNSEEN_IN.items()) or parent.tag == "details" and parent.info == "closed" and tag != "summary":
            seen = False
        if tag in VOID:
            if seen and tag == "br":
                parent.out.append("\n" if parent.pre else 0)
            elif seen and tag == "hr":
                parent.out.append(2)
            elif seen and vis and tag == "input" and found.get("value") and found.get("type", "").lower() not in NO_VALUE:
                parent.out.append(f" {entities.unescape(found['value'])} ")
            return None
        pre = tag in PRE or tag in BLOCK and tag not in COLLECTS and tag not in INDENTS and tag not in OF_TABLE and style.get("white-space") in ("pre", "pre-wrap", "break-spaces")
        node = Node(tag, parent.out if seen else [], seen, vis, parent.pre or pre)
        node.box = pre and not parent.pre
        if seen and tag in BLOCK and not (tag in ("option", "optgroup") and self.at["select"]):
            node.out.append(2 if tag in PARAGRAPH else 1)
        if tag in LISTS:  # numbers from, step, kind, marks of a reversed list
            reverse = tag == "ol" and "reversed" in found
            node.info = [number(found.get("start"), -(10**9), 1), -1 if reverse else 1, found.get("type", "1") if tag == "ol" else None, [] if reverse and "start" not in found else None]
            if seen and self.nearest(("li",)) > self.nearest(SCOPE):
                node.out[-1] = 1
        elif tag in ("table", "tr"):
            node.info, node.out = [], []
        elif tag in ("td", "th"):
            node.info = min(number(found.get("colspan"), 1, 1), 1000), min(number(found.get("rowspan"), 0, 1), 65534)
        elif tag == "details" and "open" not in found:
            node.info = "closed"
        elif tag == "select":
            node.info = ["multiple" in found or number(found.get("size"), 0, 0) > 1, []]
        elif tag == "option":
            node.info = "selected" in found
        if seen and (tag in COLLECTS or node.box):
            node.out = []
        elif seen and tag in INDENTS:
            mark = "  "
            if tag == "li":
                mark, of = "- ", parent.info if parent.tag in LISTS else None
                if of and of[2] is not None:
                    of[0] = number(found.get("value"), -(10**9), of[0])
                    mark, of[0] = ordinal(of[0], of[2]), of[0] + of[1]
            node.out.append(Open(mark))
            if tag == "li" and of and of[3] is not None:
                of[3].append(node.out[-1])
        self.at[tag].append(len(self.stack))
        self.stack.append(node)
        return None

    def close_implied(self, ends, stops) -> None:
        while (i := self.nearest(ends)) > self.nearest(stops):
            while len(self.stack) > i:
                self.pop()
            if ends == {"p"}:
                return

    def end(self, tag: str) -> None:
        if tag in HEADING and self.stack[-1].tag in HEADING:
            return self.pop()
        i = self.nearest((tag,))
        if i > (0 if tag == "table" else self.nearest(("table",)) if tag in OF_TABLE else self.nearest(SCOPE - {tag})):
            while len(self.stack) > i:
                self.pop()
        elif tag == "p" and self.stack[-1].seen:
            self.stack[-1].out.append(2)
        elif tag == "br":
            self.open("br", {})
        return None

    def pop(self) -> None:
        node = self.stack.pop()
        self.at[node.tag].pop()
        parent, tag = self.stack[-1], node.tag
        if not node.seen:
            return
        if tag in INDENTS:
            k = INDENTS[tag]
            parent.out += [CLOSE, k]
        elif tag in ("td", "th"):
            lines = lay_out(node.out)
            if parent.tag == "tr":
                parent.info.append((*node.info, lines))
            else:  # a cell outside a row
                parent.out += [1, Lines(lines), 1] if lines else []
        elif tag == "tr":
            extra, i = lay_out(node.out), self.nearest(("table",))
            if i:
                if extra:  # text between cells stands before the table's row
                    self.stack[i].info.append([(1, 1, extra)])
                self.stack[i].info.append(node.info)
            else:
                parent.out += [1, Lines([*extra, *table_lines([node.info])]), 1]
        elif tag == "table":
            before, lines = lay_out(node.out), table_lines(node.info)
            parent.out += [2, Lines(before), Lines(lines), 2] if before else [2, Lines(lines), 2] if lines else [2]
        elif node.box:
            lines = [x.rstrip() for x in preformatted(node.out).removeprefix("\n").split("\n")]
            while lines and not lines[-1]:
                lines.pop()
            k = 2 if tag in PARAGRAPH else 1
            parent.out += [k, Lines(lines), k] if lines else [k]
        elif tag == "caption":
            lines = lay_out(node.out)
            parent.out += [1, Lines(lines), 1] if lines else [1]
        elif tag == "option":
            i, lines = self.nearest(("select",)), lay_out(node.out)
            if i:
                self.stack[i].info[1].append((node.info, lines))
            else:
                parent.out += [1, Lines(lines), 1] if lines else []
        elif tag == "select":
            every, options = node.info
            one = next((x for chosen, x in reversed(options) if chosen), options[0][1] if options else [])
            if every:
                parent.out += [1, Lines([x for _, o in options for x in o]), 1]
            elif one:
                parent.out.append(f" {' '.join(one)} ")
        elif tag in BLOCK and tag != "optgroup":
            node.out.append(2 if tag in PARAGRAPH else 1)
            if tag in LISTS and node.info[3]:
                for n, x in zip(range(len(node.info[3]), 0, -1), node.info[3], strict=True):
                    x.mark = ordinal(n, node.info[2])


def preformatted(items: list) -> str:
    """Text as it stands, with a new line wherever a block begins or ends within it."""
    out: list[str] = []
    for x in items:
        if isinstance(x, str):
            out.append(x)
        elif x == 0 and isinstance(x, int):
            out.append("\n")
        elif isinstance(x, Lines):
            out.append("\n".join(x))
        elif isinstance(x, Open):
            out.append(x.mark)
        elif out and not out[-1].endswith("\n") and x is not CLOSE:
            out.append("\n")
    return "".join(out).replace("\r\n", "\n").expandtabs(8)


def render(source: str | None, rules: list[tuple] = ()) -> tuple[str, str]:
    """Title and visible text of a page. Null is an empty page; text outside any tag is visible. A page whose own rules hide or
    show elements is built once more, as they also hold for what stands before them."""
    b, at, source = Builder(rules), 0, source or ""
    last, dead = source.rfind(">"), set()
    while m := TOKEN.search(source, at):
        if m["tag"] and m.end() > last:  # from here on no tag ends
            b.text(source[at : UNENDED.search(source, m.start()).start()])
            at = len(source)
            break
        if m.start() > at:
            b.text(source[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        found, at = attributes(source, at, dead)
        if m["end"]:
            b.end(tag)
            continue
        inside = b.at["svg"] or b.at["math"]  # there, titles and styles are elements as others are
        b.open(tag, found)
        if tag == "plaintext":
            b.text(source[at:], raw=True)
            at = len(source)
        elif tag in RAW:
            m = RAW_END[tag].search(source, at)
            stop = m.start() if m else len(source)
            if tag == "title" and not b.title and not inside:
                b.title.append(entities.unescape(source[at:stop]))
            elif tag == "xmp":
                b.text(source[at:stop], raw=True)
            elif tag == "style" and not rules and found.get("media", "all").strip().lower() in ("", "all", "screen"):
                b.found += rules_of(source[at:stop])
            elif tag == "textarea":
                for k, line in enumerate(re.split(r"\r\n?|\n", re.sub(r"\A(?:\r\n?|\n)", "", source[at:stop]))):
                    if k:
                        b.stack[-1].out.append(0)
                    b.text(line)
            at = stop
    b.text(source[at:])
    while len(b.stack) > 1:
        b.pop()
    if b.found:
        return render(source, b.found)
    return SPACES.sub(" ", "".join(b.title)).strip(), "\n".join(lay_out(b.top))


def extract(pages: DataFrame, html_col: str = "html", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """pages without the html, with its title and visible text; both empty for null. Columns of those names are replaced.
    Rows are rendered one by one, repeated rows and equal pages each alike; empty input gives no rows. Only the html goes to
    Python, whole and once."""
    keep = [c for c in pages.columns if c not in (html_col, title_col, text_col)]
    small_batches(pages.sparkSession)

    @F.arrow_udf("title string, text string")
    def run(sources: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (p for whole in sources for p in by_bytes(whole)):
            got = [render(h) for h in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in got], pa.string()) for i in (0, 1)], names=["title", "text"])

    out = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), run(F.col(f"`{html_col}`")).alias("r"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), F.col("r.title").alias(title_col), F.col("r.text").alias(text_col))
