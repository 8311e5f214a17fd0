"""Rendered pages against a plain recursive layout of the trees that they were written from."""

import random
import unicodedata

import pytest

from factloom.llm import html_layout

WORDS = ["one", "two", "Ünder", "日本", "état", "a", "long-word", "x&y"]
GAP = {"div": 1, "p": 2, "h2": 2, "ul": 2, "ol": 2, "blockquote": 2, "table": 2, "section": 1, "li": 1}
OPTIONAL = {"p", "li", "td", "tr"}


def words(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4)))


def inline(r, depth=0):
    out = []
    for _ in range(r.randint(1, 3)):
        kind = r.random()
        if kind < 0.6 or depth > 1:
            out.append(words(r) + r.choice(["", " ", "\n "]))
        elif kind < 0.75:
            out.append(("br", {}, []))
        elif kind < 0.9:
            out.append((r.choice(["b", "span", "a"]), {}, inline(r, depth + 1)))
        else:
            out.append(("span", dict([r.choice([("style", "display: none"), ("style", "color:red;/* ; */visibility:hidden"), ("hidden", ""), ("class", "gone"), ("id", "off"), ("class", "a b")])]), inline(r, depth + 1)))
    return out


def block(r, depth=0):
    tag = r.choice(["p", "p", "h2", "div", "section", "ul", "ol", "blockquote", "table"])
    if tag in ("p", "h2") or depth > 2:
        return ("h2" if tag == "h2" else "p", {"class": "gone"} if r.random() < 0.1 else {}, inline(r))
    if tag in ("ul", "ol"):
        return (tag, {}, [("li", {}, inline(r) + ([block_list(r)] if depth < 2 and r.random() < 0.3 else [])) for _ in range(r.randint(1, 4))])
    if tag == "table":
        return (tag, {}, [("tr", {}, [("td", {}, inline(r, 2)) for _ in range(r.randint(1, 4))]) for _ in range(r.randint(1, 4))])
    return (tag, {}, [block(r, depth + 1) for _ in range(r.randint(0, 3))])


def block_list(r):
    return (r.choice(["ul", "ol"]), {}, [("li", {}, inline(r)) for _ in range(r.randint(1, 3))])


def write(r, node):
    if isinstance(node, str):
        return node.replace("&", "&amp;")
    tag, attrs, children = node
    said = "".join(f' {k}="{v}"' for k, v in attrs.items())
    if tag == "br":
        return "<br>"
    body = "".join(write(r, c) for c in children)
    return f"<{tag}{said}>{body}" + ("" if tag in OPTIONAL and r.random() < 0.5 else f"</{tag}>")


def width(s):
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def hidden(attrs):
    return "hidden" in attrs or "none" in attrs.get("style", "") or attrs.get("class") in ("gone", "a b")


def flow(nodes, in_list=False):
    """Lines, and the gaps that the box has before and after them."""
    out, run, gap, lead = [], [], 0, 0

    def place(lines):
        nonlocal gap, lead
        if not out:
            lead = gap
        elif gap == 2 and out[-1]:
            out.append("")
        gap = 0
        out.extend(lines)

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            place([text])
        return bool(text)

    def walk(nodes, seen=True):
        nonlocal gap
        for n in nodes:
            if isinstance(n, str):
                run.append(n if seen else "")
                continue
            tag, attrs, children = n
            if hidden(attrs):
                continue
            if tag == "br":
                had = flush()
                gap = max(gap, 1 if had else 2)
            elif tag not in GAP:
                walk(children, seen and "visibility" not in attrs.get("style", "") and attrs.get("id") != "off")
            else:
                flush()
                gap = max(gap, 1 if in_list and tag in ("ul", "ol") else GAP[tag])
                lines, first, last = table(children) if tag == "table" else items(tag, children) if tag in ("ul", "ol") else flow(children, in_list)
                if tag == "blockquote":
                    lines = [f"  {x}" if x else "" for x in lines]
                gap = max(gap, first)
                if lines:
                    place(lines)
                gap = max(gap, last, GAP[tag])

    walk(nodes)
    flush()
    return out, lead, gap


def items(tag, children):
    out, number, gap, lead = [], 0, 1, 0
    for _, _, inner in children:
        number += 1
        lines, first, last = flow(inner, True)
        mark = "- " if tag == "ul" else f"{number}. "
        gap = max(gap, first)
        if lines:
            if not out:
                lead = gap
            elif gap == 2 and out[-1]:
                out.append("")
            out += [mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])]
            gap = 0
        gap = max(gap, last, 1)
    return out, lead, gap


def table(rows):
    cells = [[flow(c)[0] for _, _, c in row] for _, _, row in rows]
    if all(len(r) < 2 for r in cells):
        return [x for r in cells for c in r for x in c], 0, 0
    wide = [max((width(x) for r in cells if len(r) > i for x in r[i]), default=0) for i in range(max(map(len, cells)))]
    out = []
    for row in cells:
        for k in range(max((len(c) for c in row), default=0)):
            parts = [c[k] if k < len(c) else "" for c in row]
            out.append(" | ".join(x + " " * (wide[i] - width(x)) for i, x in enumerate(parts)).rstrip())
    return out, 0, 0


RULES = "<style>.gone{display:none} p{color:red} #off{visibility:hidden} .a.b, .never p{display:none} @media print{p{display:none}}</style>"


@pytest.mark.parametrize("seed", range(40))
def test_random_pages(seed):
    r = random.Random(seed)
    for _ in range(25):
        tree = [block(r) for _ in range(r.randint(1, 6))]
        page = "".join(write(r, n) for n in tree)
        page = r.choice([f"<html><head><title>T &amp; t</title>{RULES}</head><body>{page}</body></html>", f"<title>T &amp; t</title>{page}{RULES}"])
        title, text = html_layout.render(page)
        assert title == "T & t"
        assert text == "\n".join(flow(tree)[0]), page


def test_rules_and_columns():
    show = lambda h: html_layout.render(h)[1]
    assert show("<style>.x{display:none}</style><p class=x>secret<p>ok") == "ok"
    assert show("<p class=x>secret<p>ok<style>.x{display:none}</style>") == "ok"
    assert show('<p style="/* c */display:none">no<p style="color:red;/*;*/ display : none !important">no<p>ok') == "ok"
    assert show("<style>p{display:none} p.on{display:block} #q{display:none!important}</style><p>no<p class='on z'>yes<p id=q class=on style='display:block'>no") == "yes"
    assert show("<style media=print>p{display:none}</style><p>yes") == "yes"
    assert show("<style>@media (x){p{display:none}} div>p{display:none}</style><div><p>yes</div>") == "yes"
    assert show("<script>'<style>p{display:none}</style>'</script><p>yes") == "yes"
    assert show("<table><tr><td>日本<td>x<tr><td>ab<td>y<tr><td>é<td>z</table>") == "日本 | x\nab   | y\né    | z"
    assert show("<div style='white-space:pre'>a\n  b</div>c") == "a\n  b\nc"
    assert show("<style>div{visibility:hidden} b{visibility:visible}</style><div>no <b>yes</b></div>") == "yes"
