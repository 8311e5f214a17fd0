"""Header-aware chunks of markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Tokens of a chunk and of its overlap, characters per token, separators by preference.
SIZE, OVERLAP, SEPARATORS = 512, 75, ("\n\n", "\n", " ")
#: White space at which texts are trimmed, and characters that end a line.
SPACE = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ENDS = "\n\r\u2028\u2029"
#: A line that is a header, and where one may begin in a text.
HEADER = rf"\A(#{{1,3}})[{SPACE}]+([^{ENDS}]+)\z"
ANY_HEADER = rf"(?:\A|(?<=[{ENDS}]))#{{1,3}}[{SPACE}]"
#: Lengths are UTF-16 units: a character beyond the basic plane is followed by this one, which no text uses, as its second half.
HALF = "\ufdd0"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
FIELDS = ("h1", "h2", "h3", "content", "preview")


def units(text) -> Column:
    """The text with a character for each UTF-16 unit."""
    return F.when(F.rlike(text, F.lit(ASTRAL)), F.regexp_replace(text, f"({ASTRAL})", f"$1{HALF}")).otherwise(T.col(text))


def characters(text) -> Column:
    """The text of units; halves that lost their other half become U+FFFD."""
    text = T.col(text)
    whole = F.regexp_replace(F.regexp_replace(text, rf"\A{HALF}", "\ufffd"), rf"{ASTRAL}\z", "\ufffd")
    return F.when(F.contains(text, F.lit(HALF)) | F.rlike(text, F.lit(rf"{ASTRAL}\z")), F.regexp_replace(whole, HALF, "")).otherwise(text)


def trimmed(text) -> Column:
    return F.btrim(text, F.lit(SPACE))


def bound(value, use) -> Column:
    """use(value), computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def header_states(lines) -> Column:
    """Of each header line its place and the headers that hold from it on: it clears those below its level."""
    found = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.length(F.regexp_extract(x, HEADER, 1)).alias("level"), trimmed(F.regexp_extract(x, HEADER, 2)).alias("title")))
    marks = F.filter(found, lambda m: m["level"] > 0)
    none = F.array().cast("array<struct<i int, h1 string, h2 string, h3 string>>")

    def follow(known, m):
        last, level = F.get(known, F.size(known) - 1), m["level"]
        held = lambda n: F.when(level == n, m["title"]).when(level > n, F.coalesce(last[f"h{n}"], F.lit(""))).otherwise("")
        return F.concat(known, F.array(F.struct(m["i"].alias("i"), *(held(n).alias(f"h{n}") for n in (1, 2, 3)))))

    return F.aggregate(marks, none, follow)


def sections(lines, states) -> Column:
    """(h1, h2, h3, body) between headers, blank ones too, and what stands before the first header."""
    size = F.size(lines)
    first = F.coalesce(F.get(states, F.lit(0))["i"], size)
    body = lambda begin, end: F.array_join(F.slice(lines, begin + 1, end - begin), "\n")
    before = F.when(first > 0, F.array(F.struct(F.lit("").alias("h1"), F.lit("").alias("h2"), F.lit("").alias("h3"), body(F.lit(0), first).alias("body"))))
    after = F.transform(states, lambda s, k: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), s["h3"].alias("h3"), body(s["i"], F.coalesce(F.get(states, k + 1)["i"], size)).alias("body")))
    return F.concat(F.coalesce(before, F.array().cast("array<struct<h1 string, h2 string, h3 string, body string>>")), after)


def boundary(run, most: int) -> Column:
    """How much of a run of `most` units is taken: up to and with the last of the most preferred separator in its second half."""
    last = lambda s: F.length(run) - F.locate(s, F.reverse(run)) - len(s) + 1  # noqa: E731  separators read the same backwards
    ends = [F.when((F.locate(s, F.reverse(run)) > 0) & (last(s) > most / 2), last(s) + len(s)) for s in SEPARATORS]
    return F.coalesce(*ends, F.lit(most))


def windows(text, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Runs of at most 4 * size units. The next run begins overlap tokens before the end of the last one, if that lies
    beyond the length of the last piece that was kept, else at its end, so the first boundary has no overlap.

    A fold over as many steps as there can be; runs are cut from blocks of their length, so that a step costs the same
    wherever it is in the text.
    """
    most = 4 * size
    state = "struct<start int, done boolean, last int, out array<string>>"

    def runs(t) -> Column:
        n = F.length(t["text"])
        steps = F.sequence(F.lit(1), F.ceil(n / max(1, most // 2 - 4 * overlap)).cast("int") + 1)

        def step(s, _):
            at = F.floor(s["start"] / most).cast("int")
            run = F.substring(F.concat(F.get(t["blocks"], at), F.coalesce(F.get(t["blocks"], at + 1), F.lit(""))), s["start"] % most + 1, F.lit(most))
            taken = bound(run, lambda r: bound(F.when(s["start"] + most >= n, F.length(r)).otherwise(boundary(r, most)), lambda k: F.struct(k.alias("k"), trimmed(F.substring(r, F.lit(1), k)).alias("piece"))))

            def after(x):
                end, piece = s["start"] + x["k"], x["piece"]
                last = F.when(piece != "", F.length(piece)).otherwise(s["last"])
                back = end - 4 * overlap
                out = F.when(piece != "", F.concat(s["out"], F.array(piece))).otherwise(s["out"])
                return F.struct(F.when(back > last, back).otherwise(end).cast("int").alias("start"), (end >= n).alias("done"), last.cast("int").alias("last"), out.alias("out")).cast(state)

            return F.when(s["done"], s).otherwise(bound(taken, after))

        start = F.struct(F.lit(0).alias("start"), (n == 0).alias("done"), F.lit(0).alias("last"), F.array().cast("array<string>").alias("out")).cast(state)
        return F.aggregate(steps, start, step)["out"]

    return bound(F.struct(T.col(text).alias("text"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{most}}}"), F.lit(0)).alias("blocks")), runs)


def pieces(text, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """(h1, h2, h3, piece) in units: none of blank text, one of text without headers, else those of each section."""
    kind = "array<struct<h1 string, h2 string, h3 string, piece string>>"
    piece = lambda x, p: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["h3"].alias("h3"), p.alias("piece"))
    blank = F.struct(*(F.lit("").alias(h) for h in FIELDS[:3]))
    whole = units(F.regexp_replace(text, r"\A---\n(?s:.*?)\n---\n+", ""))

    def cut(x):
        return bound(trimmed(x["body"]), lambda b: F.transform(F.when(F.length(b) <= 4 * size, F.array(b)).otherwise(windows(b, size, overlap)), lambda p: piece(x, p)))

    def headed(t):
        return bound(F.split(t, "\n"), lambda lines: bound(header_states(lines), lambda states: F.flatten(F.transform(sections(lines, states), cut))))

    made = bound(whole, lambda t: F.when(F.rlike(t, F.lit(ANY_HEADER)), headed(t).cast(kind)).otherwise(F.array(piece(blank, trimmed(t))).cast(kind)))
    return F.when(trimmed(text) == "", F.array().cast(kind)).otherwise(made)


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs(doc_id, doc_type, source_file, content) as chunks with their place, headers, tokens and preview (F25: the
    first 200 units, trimmed). Expressions of one row, without Python and without a shuffle. Null contents count as empty."""
    rows = docs.select("doc_id", "doc_type", "source_file", F.posexplode(pieces(F.coalesce("content", F.lit("")), size, overlap)).alias("chunk_index", "c"))
    text = {"h1": "c.h1", "h2": "c.h2", "h3": "c.h3", "content": "c.piece", "preview": trimmed(F.substring("c.piece", 1, 200))}
    rows = rows.select("doc_id", "doc_type", "source_file", "chunk_index", *(characters(x).alias(n) for n, x in text.items()))
    return rows.select("doc_id", "doc_type", "source_file", "chunk_index", T.section_path("h1", "h2", "h3").alias("section_path"), "h1", "h2", "h3", T.estimate_tokens("content").cast("int").alias("token_count"), F.col("preview").alias("content_preview"), "content")


def generated_docs(spark, path: str, index: str = "00-INDEX.md") -> DataFrame:
    """Markdown files of a folder but the index, with their ids and types."""
    files = spark.read.text(f"{path}/*.md", wholetext=True).withColumn("source_file", T.basename(F.input_file_name()))
    stem = F.lower(T.strip_extension("source_file"))
    return files.filter(F.col("source_file") != index).select(stem.alias("doc_id"), F.regexp_replace(stem, r"^\d+-", "").alias("doc_type"), "source_file", F.col("value").alias("content"))
