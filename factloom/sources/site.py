"""A browsable site of markdown documents, and S24: reports as files."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

FENCE = re.compile(r"^(`{3,}|~{3,})\s*(\S*)\s*$")
ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
DIVIDER = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
COMMENT = re.compile(r"^\s*<!--[\s\S]*?-->\s*$")
INLINE = re.compile(r"(?P<code>`+)(?P<c>.+?)(?P=code)|!\[(?P<alt>[^\]]*)\]\((?P<img>[^)\s]+)[^)]*\)|\[(?P<label>[^\]]+)\]\((?P<href>[^)\s]+)[^)]*\)|\*\*(?P<b>.+?)\*\*|(?<![\w*])[*_](?P<i>[^*_\n]+)[*_](?![\w*])|~~(?P<s>.+?)~~|(?P<url>https?://[^\s<>()]+)")


def inline(text: str) -> str:
    """Text of a line as HTML; what it holds of HTML is shown as it stands."""
    out, at = [], 0
    for m in INLINE.finditer(text):
        out.append(html.escape(text[at : m.start()], False))
        at = m.end()
        if m["code"]:
            out.append(f"<code>{html.escape(m['c'].strip(' '), False)}</code>")
        elif m["img"] is not None:
            out.append(f'<img src="{html.escape(m["img"])}" alt="{html.escape(m["alt"])}">')
        elif m["href"] is not None:
            out.append(f'<a href="{html.escape(m["href"])}">{inline(m["label"])}</a>')
        elif m["url"]:
            out.append(f'<a href="{html.escape(m["url"])}">{html.escape(m["url"], False)}</a>')
        else:
            tag = "strong" if m["b"] else "em" if m["i"] else "del"
            out.append(f"<{tag}>{inline(m['b'] or m['i'] or m['s'])}</{tag}>")
    return "".join(out) + html.escape(text[at:], False)


def cells(row: str) -> list[str]:
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", row.strip().removeprefix("|").removesuffix("|"))]


def listing(items: list[tuple[int, bool, list[str]]]) -> str:
    """Items (indent, numbered, lines) as nested lists."""
    out, stack = [], []
    for indent, numbered, lines in items:
        while stack and indent < stack[-1][0]:
            out.append(f"</li></{stack.pop()[1]}>")
        tag = "ol" if numbered else "ul"
        if stack and indent < stack[-1][0] + 2 and stack[-1][1] == tag:
            out.append("</li>")
        elif not stack or indent >= stack[-1][0] + 2:
            out.append(f"<{tag}>")
            stack.append((indent, tag))
        else:
            out.append(f"</li></{stack.pop()[1]}><{tag}>")
            stack.append((indent, tag))
        body = inline(" ".join(lines))
        out.append("<li>" + re.sub(r"^\[([ xX])\] ", lambda m: f'<input type="checkbox" disabled{"" if m[1] == " " else " checked"}> ', body))
    while stack:
        out.append(f"</li></{stack.pop()[1]}>")
    return "".join(out)


def to_html(text: str) -> str:
    """Markdown as HTML: headings, paragraphs, lists, quotes, tables, fences (of diagrams as such) and rules. Raw HTML is
    escaped and comments go, as documents may come from anywhere."""
    lines, out, i, para = text.split("\n"), [], 0, []

    def end() -> None:
        if para:
            out.append(f"<p>{inline(chr(10).join(para))}</p>")
            para.clear()

    while i < len(lines):
        x = lines[i]
        fence, item = FENCE.match(x), ITEM.match(x)
        if fence:
            end()
            j = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(fence[1]) and not lines[k].strip().strip(fence[1][0])), len(lines))
            body = "\n".join(lines[i + 1 : j])
            code = f' class="language-{html.escape(fence[2])}"' if fence[2] else ""
            out.append(f'<pre class="mermaid">{html.escape(body, False)}</pre>' if fence[2] == "mermaid" else f"<pre><code{code}>{html.escape(body, False)}\n</code></pre>")
            i = j + 1
            continue
        if x.lstrip().startswith("<!--") and not para:
            j = next((k for k in range(i, len(lines)) if "-->" in lines[k]), None)
            if j is not None and COMMENT.match("\n".join(lines[i : j + 1])):
                i = j + 1
                continue
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", x):
            end()
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif not x.strip():
            end()
        elif RULE.match(x) and not para:
            out.append("<hr>")
        elif x.lstrip().startswith(">"):
            end()
            j = i
            while j < len(lines) and lines[j].strip() and (lines[j].lstrip().startswith(">") or j > i):
                j += 1
            out.append("<blockquote>" + to_html("\n".join(re.sub(r"^\s*> ?", "", y) for y in lines[i:j])) + "</blockquote>")
            i = j
            continue
        elif "|" in x and i + 1 < len(lines) and DIVIDER.match(lines[i + 1]) and len(cells(x)) == len(cells(lines[i + 1])):
            end()
            j = i + 2
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                j += 1
            head, n = cells(x), len(cells(x))
            rows = ["".join(f"<td>{inline(c)}</td>" for c in (cells(y) + [""] * n)[:n]) for y in lines[i + 2 : j]]
            out.append("<table><thead><tr>" + "".join(f"<th>{inline(c)}</th>" for c in head) + "</tr></thead><tbody>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</tbody></table>")
            i = j
            continue
        elif item and not para:
            items: list = []
            while i < len(lines):
                y, m = lines[i], ITEM.match(lines[i])
                if m:
                    items.append((len(m[1]), m[2][0].isdigit(), [m[3]]))
                elif y.strip() and (y.startswith(" ") or lines[i - 1].strip()) and not FENCE.match(y) and not y.startswith("#"):
                    items[-1][2].append(y.strip())
                elif y.strip() or not any(ITEM.match(z) for z in lines[i + 1 : i + 2]):
                    break
                i += 1
            out.append(listing(items))
            continue
        else:
            para.append(x.strip())
        i += 1
    end()
    return "\n".join(out)


def front_matter(text: str) -> tuple[str | None, str]:
    """The title that the text's head names, and the text below it."""
    m = re.match(r"\A---\n(.*?)\n---\n?", text, re.S)
    if not m:
        return None, text
    title = re.search(r"(?m)^title:[ \t]*(.+?)[ \t]*$", m[1])
    return (title[1].strip("\"'") if title else None), text[m.end() :]


def title_of(filename: str) -> str:
    """'06-MODULES.md' as 'Modules'."""
    name = re.sub(r"[-_]+", " ", re.sub(r"^\d+[-_]", "", re.sub(r"(?i)\.md$", "", filename))).strip().lower()
    return re.sub(r"\b[a-z]", lambda m: m[0].upper(), name)


STYLE = "body{margin:0;font:16px/1.6 sans-serif}.layout{display:flex}.sidebar{min-width:16rem;padding:1.5rem 1rem}.content{max-width:52rem;padding:2rem}pre{overflow-x:auto}td,th{border:1px solid;padding:.4rem .6rem}"


def page(title: str, body: str, nav: str) -> str:
    return f'<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>{html.escape(title)}</title>\n<style>{STYLE}</style>\n</head>\n<body>\n<div class="layout">\n{nav}\n<main class="content">\n{body}\n</main>\n</div>\n</body>\n</html>\n'


def site(docs: DataFrame) -> DataFrame:
    """Pages (filename, html) of docs(source_file, content): each with the navigation of all, links between documents leading
    to pages, and an index that leads to the first if none is among them. The navigation is a line for each document."""
    @F.pandas_udf("title string, body string")
    def convert(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, texts in batches:
            rows = []
            for name, text in zip(names, texts, strict=True):
                title, body = front_matter(text or "")
                rows.append((title or title_of(name), to_html(body)))
            yield pd.DataFrame(rows, columns=["title", "body"])

    rows = docs.select(F.regexp_replace("source_file", r"(?i)\.md$", ".html").alias("filename"), convert("source_file", "content").alias("r")).select("filename", "r.*")
    listed = rows.select("filename", "title").orderBy("filename").collect()
    if not listed:
        return rows.select("filename", F.lit("").alias("html")).limit(0)
    items = "\n".join(f'<li><a href="{html.escape(r.filename)}">{html.escape(r.title)}</a></li>' for r in listed)
    nav = f'<nav class="sidebar">\n<ul>\n{items}\n</ul>\n</nav>'
    before, after = page("\x00", "\x01", nav).split("\x00")
    middle, after = after.split("\x01")
    body = T.rewrite_md_links("body")
    pages = rows.select("filename", F.concat(F.lit(before), T.escape_html("title"), F.lit(middle), body, F.lit(after)).alias("html"))
    if all(r.filename != "index.html" for r in listed):
        to = html.escape(listed[0].filename)
        lead = f'<!doctype html>\n<meta charset="utf-8">\n<meta http-equiv="refresh" content="0; url={to}">\n<title>Redirecting</title>\n<a href="{to}">Continue to the documentation</a>\n'
        pages = pages.unionByName(docs.sparkSession.createDataFrame([("index.html", lead)], "filename string, html string"))
    return pages


def table(headers: list[str], rows: list[list]) -> str:
    """a markdown table."""
    escape = lambda c: str("" if c is None else c).replace("\\", "\\\\").replace("|", "\\|")
    line = lambda cs: f"| {' | '.join(map(escape, cs))} |"
    return "\n".join([line(headers), f"| {' | '.join('---' for _ in headers)} |", *map(line, rows)])


def report(title: str, sections: list[tuple[str, DataFrame, int]]) -> tuple[str, str]:
    """A report as markdown and as JSON: of each section (title, rows in order, most) the first rows."""
    parts, data = [f"# {title}"], {}
    for name, df, most in sections:
        rows = [r.asDict(True) for r in df.limit(most).collect()]  # a section's limit
        data[name] = rows
        parts += ["", f"## {name}", "", table(df.columns, [[r[c] for c in df.columns] for r in rows]) if rows else "_None_"]
    return "\n".join(parts) + "\n", json.dumps(data, default=str, ensure_ascii=False)
