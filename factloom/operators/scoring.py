"""File scores, summaries of files, and packing into a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.written import Work

#: Weights, steps and caps of the score.
ENTRY, IMPORT_STEP, IMPORT_CAP, EXPORT_STEP, EXPORT_CAP, GIT_CAP, EDGE, CONFIG, TEST = 30, 3, 30, 2, 20, 10, 10, 15, -15
#: A file above so many tokens with at least this score is cut to sections; lines of a fallback summary.
OVERSIZE_TOKENS, OVERSIZE_SCORE, SUMMARY_LINES = 8000, 30, 20
#: Files that are left out, and what makes an entry point, a configuration and a test.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum")
ENTRY_POINT = (r"^(index|main|app|server|cli)\.[^/]+$", r"/(?:index|main|app|server)\.[^/]+$", r"^src/(?:index|main|app|server)\.[^/]+$")
CONFIG_FILE = (r"\.config\.[^/]+$", r"^\.?(babel|eslint|prettier|jest|vitest|webpack|tsconfig|rollup|vite)", r"^\.env", r"^(package\.json|Cargo\.toml|go\.mod|pyproject\.toml|Makefile|Dockerfile)$")
TEST_FILE = (r"\.test\.", r"\.spec\.", r"__tests__/", r"__test__/")
#: What marks a function of an oversized file as an edge case.
EDGE_MARKERS = r"\b(TODO|FIXME|HACK|XXX)\b"


def matches(path, patterns: tuple) -> Column:
    """Whether one of the patterns is found in the path."""
    return F.rlike(path, F.lit("|".join(f"(?:{p})" for p in patterns)))


def score(files: DataFrame, facts: list[DataFrame] = ()) -> DataFrame:
    """files(path) with any of importers, exports, changes, todos joined by path; missing facts count 0.

    Importers that name no file are looked up by the path without its extension.
    """
    df = files.filter(~T.basename("path").isin(*LOCK_FILES))
    for f in facts:
        df = df.join(f, "path", "left")
        if "importers" in f.columns:
            bare = f.select(F.col("path").alias("bare"), F.col("importers").alias("by_bare"))
            df = df.withColumn("bare", T.strip_extension("path")).join(bare, "bare", "left").withColumn("importers", F.coalesce("importers", "by_bare")).drop("bare", "by_bare")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
    hit = lambda p, v: F.when(matches("path", p), v).otherwise(0)
    parts = {
        "entry_point": hit(ENTRY_POINT, ENTRY), "import_count": F.least(n("importers") * IMPORT_STEP, F.lit(IMPORT_CAP)), "export_count": F.least(n("exports") * EXPORT_STEP, F.lit(EXPORT_CAP)),
        "git_activity": F.least(n("changes"), F.lit(GIT_CAP)), "edge_cases": F.when(n("todos") > 0, EDGE).otherwise(0), "config_file": hit(CONFIG_FILE, CONFIG), "test": hit(TEST_FILE, TEST),
    }
    total = sum(parts.values(), F.lit(0))
    return df.select("path", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("score"), F.struct(*(v.cast("int").alias(k) for k, v in parts.items() if k != "test")).alias("breakdown"))


def by_score(scored: DataFrame) -> DataFrame:
    """O1: best first, then paths as people sort them."""
    return scored.orderBy(F.desc("score"), F.collate("path", "UNICODE"), "path")


def _call(f) -> Column:
    """name(a: A, b): R of a function symbol."""
    params = F.transform(f["parameters"], lambda p: F.concat(p["name"], F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(F.lit(": "), p["type"])).otherwise("")))
    back = F.when(F.coalesce(f["return_type"], F.lit("")) != "", F.concat(F.lit(": "), f["return_type"])).otherwise("")
    return F.concat(f["name"], F.lit("("), F.array_join(params, ", "), F.lit(")"), back)


def signature_summary(path="path", ast="ast") -> Column:
    """K2: exported functions, classes with their public methods, constants, and where imports come from; ast: a column as
    symbols.AST."""
    path, a = T.col(path), T.col(ast)
    names = F.transform(a["exports"], lambda e: e["name"])
    head = F.concat(F.lit("// FILE: "), path, F.lit(" ("), a["line_count"].cast("string"), F.lit(" lines)"))
    functions = F.transform(F.filter(a["functions"], lambda f: F.array_contains(names, f["name"])), lambda f: F.concat(F.lit("export "), F.when(f["is_async"], "async ").otherwise(""), F.lit("function "), _call(f)))
    methods = lambda c: F.array_join(F.transform(F.filter(c["methods"], lambda m: m["visibility"] == "public"), _call), "; ")
    classes = F.transform(F.filter(a["classes"], lambda c: F.array_contains(names, c["name"])), lambda c: F.concat(F.lit("export class "), c["name"], F.lit(" { "), methods(c), F.lit(" }")))
    constants = F.transform(F.filter(a["constants"], lambda c: c["is_exported"]), lambda c: F.concat(F.lit("export const "), c["name"], F.when(F.coalesce(c["type"], F.lit("")) != "", F.concat(F.lit(": "), c["type"])).otherwise("")))
    sources = F.transform(a["imports"], lambda i: i["source"])
    imports = F.when(F.size(sources) > 0, F.array(F.concat(F.lit("// "), F.size(sources).cast("string"), F.lit(" imports from: "), F.array_join(sources, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), functions, classes, constants, imports), "\n")


def fallback_summary(path, content) -> Column:
    """K3: a header, the first lines as comments, and how many more there are."""
    lines = F.split(T.col(content), "\n")
    head = F.concat(F.lit("// FILE: "), T.col(path), F.lit(" ("), F.size(lines).cast("string"), F.lit(" lines)"))
    more = F.when(F.size(lines) > SUMMARY_LINES, F.array(F.concat(F.lit("// ... ("), (F.size(lines) - SUMMARY_LINES).cast("string"), F.lit(" more lines)")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), F.transform(F.slice(lines, 1, SUMMARY_LINES), lambda x: F.concat(F.lit("// "), x)), more), "\n")


def sections(content="content", ast="ast") -> Column:
    """K4: (label, content) of exported functions, exported classes, then functions that hold an edge marker; lines that an
    earlier section covers from first to last are not taken again."""
    a, lines = T.col(ast), F.split(T.col(content), "\n")
    names = F.transform(a["exports"], lambda e: e["name"])

    def cut(symbols, label):
        return F.transform(symbols, lambda s: F.struct(s["line"].alias("line"), s["end_line"].alias("end"), F.concat(F.lit(label), s["name"]).alias("label"), F.array_join(F.slice(lines, s["line"], F.greatest(F.lit(0), s["end_line"] - s["line"] + 1)), "\n").alias("content")))

    exported = lambda kind: F.filter(a[kind], lambda s: F.array_contains(names, s["name"]))
    marked = F.filter(cut(a["functions"], "Edge case: "), lambda s: F.rlike(s["content"], F.lit(EDGE_MARKERS)))
    every = F.concat(cut(exported("functions"), "Export: "), cut(exported("classes"), "Export: "), marked)
    none = F.filter(every, lambda s: F.lit(False))
    once = F.aggregate(every, none, lambda got, s: F.when(F.exists(got, lambda g: (g["line"] == s["line"]) & (g["end"] == s["end"])), got).otherwise(F.concat(got, F.array(s))))
    return F.transform(once, lambda s: F.struct(s["label"].alias("label"), s["content"].alias("content")))


#: Columns of packing costs: tokens of the whole file (null: unreadable), UTF-16 units of its summary, whether it was parsed,
#: and per section its tokens and the units of its text with label.
COSTS = ("full", "summary_chars", "parsed", "sections")


def costs(files: DataFrame) -> DataFrame:
    """What pack() needs of files(path, content, ast): numbers only; ast null where a file was not parsed, content null where
    it could not be read."""
    parsed = F.col("ast").isNotNull()
    summary = F.when(parsed, signature_summary()).otherwise(fallback_summary("path", "content"))
    cut = F.transform(sections(), lambda s: F.struct(T.estimate_tokens(s["content"]).cast("long").alias("tokens"), (F.lit(len("// ---  ---\n")) + T.utf16_length(s["label"]) + T.utf16_length(s["content"])).cast("long").alias("chars")))
    return files.select(
        *(c for c in files.columns if c not in ("content", "ast")), F.when(F.col("content").isNotNull(), T.estimate_tokens("content")).cast("long").alias("full"), T.utf16_length(summary).cast("long").alias("summary_chars"),
        parsed.alias("parsed"), F.coalesce(F.when(parsed, cut), F.array().cast("array<struct<tokens:bigint,chars:bigint>>")).alias("sections"),
    )


def _tokens(chars) -> int:
    return -(-int(chars) // T.CHARS_PER_TOKEN)


def choice(r, left: int, compress: bool) -> tuple[str, int, str, list[int]]:
    """K6, K7: tier, tokens, shape and sections of a readable file where so many tokens are left.

    Whether a file with all its sections fits is judged by the sum of their tokens; what it costs is the tokens of the joined
    text, labels included, so that the budget may be overdrawn.
    """
    brief = _tokens(r.summary_chars)
    if compress:
        return ("signatures", brief, "summary", []) if brief <= left else SKIP
    whole = int(r.full)
    if r.changed and whole <= left:
        return "full", whole, "whole", []
    if whole > OVERSIZE_TOKENS and r.score >= OVERSIZE_SCORE and r.parsed:
        if brief > left:
            return SKIP
        parts, taken, room = [(s["tokens"], s["chars"]) for s in r.sections], [], left - brief
        for i, (tokens, _) in enumerate(parts):
            if tokens <= room:
                taken.append(i)
                room -= tokens
        every = len(taken) == len(parts)
        joined = r.summary_chars + sum(2 + parts[i][1] for i in taken) + (2 if every and not parts else 0)
        return "full" if every else "signatures", _tokens(joined), "sections", taken
    if whole <= left:
        return "full", whole, "whole", []
    return ("signatures", brief, "summary", []) if brief <= left else SKIP


def pack_plan(rows: pd.DataFrame, budget: int, compress: bool = False) -> pd.DataFrame:
    """K5-K7 on the rows of one repository that fit into memory, in order: (path, tier, tokens, rank, shape, taken), what of
    each file is taken. shape: whole, sections, summary or none; taken: places of the sections."""
    names = ["path", "tier", "tokens", "rank", "shape", "taken"]
    if not compress and rows["full"].sum() <= budget:
        return rows.assign(tier="full", tokens=rows["full"].fillna(0).astype("int64"), shape="whole", taken=[[] for _ in range(len(rows))])[names]
    left, out = budget, []
    for ok, r in zip(rows["full"].notna(), rows.itertuples(), strict=True):
        got = choice(r, left, compress) if ok else SKIP
        left -= got[1]
        out.append((r.path, got[0], got[1], r.rank, got[2], got[3]))
    return pd.DataFrame(out, columns=names)


SKIP = ("skip", 0, "none", [])


def _bounds(costs: DataFrame, compress: bool) -> DataFrame:
    """costs with `free`, the tokens of each file where there is room for all of it, `need`, the room that this takes, and
    `least`, the room without which it is passed over; least is null of files that leave the room as it is."""
    brief, full = F.ceil(F.col("summary_chars") / T.CHARS_PER_TOKEN).cast("long"), F.col("full")
    cut = (full > OVERSIZE_TOKENS) & (F.col("score") >= OVERSIZE_SCORE) & F.col("parsed") & ~F.col("changed")
    total = lambda f: F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + s[f])
    joined = F.ceil((F.col("summary_chars") + total("chars") + F.greatest(2 * F.size("sections"), F.lit(2))) / T.CHARS_PER_TOKEN).cast("long")
    if compress:
        free, need, least = brief, brief, brief
    else:
        free, need = F.when(cut, joined).otherwise(full), F.when(cut, brief + total("tokens")).otherwise(full)
        least = F.when(cut | (brief < full), brief).otherwise(full)
    out = costs.withColumn("cut", F.lit(False) if compress else F.coalesce(cut, F.lit(False)))
    out = out.withColumns({"free": F.when(full.isNull(), 0).otherwise(free), "need": F.when(full.isNull(), -(1 << 62)).otherwise(need)})
    return out.withColumn("least", F.when(full.isNotNull() & ((F.col("free") > 0) | (F.col("need") > 0)), least))


def pack(costs: DataFrame, budget: int, by: tuple = (), compress: bool = False, part_rows: int = 4096, ahead: int = 16) -> DataFrame:
    """First fit in the order of rank within each repository (`by`); a later smaller file may follow a larger one
    that was passed over. costs(by..., path, rank, score, changed and COSTS); ranks of a repository are 1, 2, ... and differ.

    Repositories of any size are cut into parts of part_rows ranks. As long as everything fits, prefix sums over parts say
    what is taken and what is left. From the first part where something does not fit, only the files go on that still could
    be taken: the room never grows, so a part whose least file is beyond it is passed over unread, and the next `ahead` parts
    that are not are folded by one task, all repositories at once. A pass takes at least one file of each repository that is
    still open, and so their number is bounded by the budget, not by the files.
    """
    work = Work(costs.sparkSession, "pack")
    own = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))  # beside which columns below may have any name
    rows = _bounds(costs.select(own.alias("own"), "path", "rank", "score", "changed", *COSTS), compress)
    rows = work.table(rows.withColumns({"repo": F.to_json("own"), "part": F.expr(f"(rank - 1) div {part_rows}")}), "rows")
    inside = Window.partitionBy("repo", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.select("repo", "part", "full", "free", "least", (F.coalesce(F.sum("free").over(inside), F.lit(0)) + F.col("need")).alias("top"))
    parts = tops.groupBy("repo", "part").agg(F.sum("free").alias("free"), F.max("top").alias("top"), F.min("least").alias("least"), F.sum("full").alias("full"))
    before = F.lit(budget) - F.coalesce(F.sum("free").over(Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = work.table(parts.withColumn("room", before.cast("long")), "parts")
    open_ = F.when(F.col("top") > F.col("room"), F.col("part"))
    fits = F.lit(not compress) & (F.coalesce(F.sum("full"), F.lit(0)) <= budget)
    first = work.table(parts.groupBy("repo").agg(fits.alias("fits"), F.min(open_).alias("since"), F.min_by("room", open_).alias("room")), "first")

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = int(pdf["room"].iloc[0]), []
        for r in pdf.sort_values("rank").itertuples():
            got = choice(r, left, compress)
            left -= got[1]
            if got is not SKIP:
                out.append((key[0], r.rank, *got, left))
        return pd.DataFrame(out, columns=["repo", "rank", "tier", "tokens", "shape", "taken", "left"])

    kind = "repo string, rank long, tier string, tokens long, shape string, taken array<int>, left long"
    state, taken, turn = first.filter("not fits and since is not null").select("repo", "since", "room"), None, 0
    while True:
        near = parts.select("repo", "part", "least").join(state, "repo").filter("part >= since and least <= room")
        near = near.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("part"))).filter(F.col("k") <= ahead)
        near = work.table(near.select("repo", "part", "room"), f"near{turn}")
        if near.isEmpty():
            break
        took = rows.drop("free", "need", "own", "path").join(near, ["repo", "part"]).filter("least <= room").groupBy("repo").applyInPandas(fold, kind)
        took = work.table(took, f"took{turn}")
        taken = took if taken is None else taken.unionByName(took)
        after = near.groupBy("repo").agg((F.max("part") + 1).alias("since"), F.first("room").alias("was"))
        after = after.join(took.groupBy("repo").agg(F.min("left").alias("left")), "repo", "left")
        state, turn = work.table(after.select("repo", "since", F.coalesce("left", "was").alias("room")), f"state{turn}"), turn + 1
    taken = rows.sparkSession.createDataFrame([], kind) if taken is None else taken
    ends = taken.filter("left < 0").groupBy("repo").agg(F.min("rank").alias("end"))
    all_ = rows.join(first.withColumnRenamed("room", "start"), "repo").join(ends, "repo", "left").join(taken.drop("left"), ["repo", "rank"], "left")
    unread, closed, idle = F.col("full").isNull(), F.expr("since is null or part < since"), F.expr("least is null and start >= 0 and (end is null or rank < end)")
    how = lambda whole, free, other, none: F.when(F.col("fits"), whole).when(unread, none).when(closed | idle, free).otherwise(F.coalesce(other, none))
    nothing = F.array().cast("array<int>")
    every = F.when(F.col("cut") & (F.size("sections") > 0), F.sequence(F.lit(0), F.size("sections") - 1)).otherwise(nothing)
    mode = ("signatures", "summary", "summary") if compress else ("full", "whole", "sections")
    return all_.select(
        *(F.col(f"own.`{c}`").alias(c) for c in by), "path", how(F.lit("full"), F.lit(mode[0]), F.col("tier"), F.lit("skip")).alias("tier"), how(F.coalesce("full", F.lit(0)), F.col("free"), F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), "rank",
        how(F.lit("whole"), F.when(F.col("cut"), mode[2]).otherwise(mode[1]), F.col("shape"), F.lit("none")).alias("shape"), how(nothing, every, F.col("taken"), nothing).alias("taken"),
    )


def packed_content(packed: DataFrame, files: DataFrame, by: tuple = ()) -> DataFrame:
    """The packed files with their contents; files(by..., path, content, ast)."""
    both = packed.join(files, [*by, "path"], "left")
    brief = F.when(F.col("ast").isNotNull(), signature_summary()).otherwise(fallback_summary("path", "content"))
    parts = F.transform("taken", lambda i: F.get(sections(), i))
    joined = F.array_join(F.transform(parts, lambda s: F.concat(F.lit("// --- "), s["label"], F.lit(" ---\n"), s["content"])), "\n\n")
    cut = F.when((F.size("taken") > 0) | (F.col("tier") == "full"), F.concat(brief, F.lit("\n\n"), joined)).otherwise(brief)
    content = F.when(F.col("shape") == "whole", F.coalesce("content", F.lit(""))).when(F.col("shape") == "sections", cut).when(F.col("shape") == "summary", brief).otherwise("")
    return both.select(*packed.columns, content.alias("content"))


def packing_summary(packed: DataFrame, budget: int, by: tuple = ()) -> DataFrame:
    """One row, or one of each repository."""
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in ("full", "signatures", "skip")]
    used = F.coalesce(F.sum("tokens"), F.lit(0))
    percent = F.floor(100 * used / F.lit(budget) + 0.5) if budget > 0 else F.lit(0)
    return packed.groupBy(*by).agg(F.count("*").alias("files"), *tiers, used.alias("used_tokens"), percent.cast("int").alias("utilisation"))


#: What is cut first to fit a round's context, and how many of each are kept at least where there are any.
CONTEXT_ORDER = (("open_questions", 0), ("findings", 1), ("relationships", 0), ("modules", 0))


def context_text(number, modules, findings, relationships, open_questions) -> Column:
    """K8: a round's result as the next one reads it."""
    line = lambda label, items, sep: F.when(F.size(items) > 0, F.array(F.concat(F.lit(label), F.array_join(items, sep)))).otherwise(F.array().cast("array<string>"))
    listed = F.when(F.size(findings) > 0, F.concat(F.array(F.lit("Findings:")), F.transform(findings, lambda f: F.concat(F.lit("- "), f)))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("## Round "), T.col(number).cast("string"), F.lit(" Context")))
    return F.array_join(F.concat(head, line("Modules: ", modules, ", "), listed, line("Relationships: ", relationships, "; "), line("Open questions: ", open_questions, "; ")), "\n")


#: What a list adds to a context's text before its items, and with each of them, in UTF-16 units.
CONTEXT_UNITS = {"modules": (len("\nModules: ") - 2, 2), "findings": (len("\nFindings:"), 3), "relationships": (len("\nRelationships: ") - 2, 2), "open_questions": (len("\nOpen questions: ") - 2, 2)}


def compress_context(rounds: DataFrame, most: int = 2000) -> DataFrame:
    """K8: rounds(round, modules, findings, relationships, open_questions) cut from the end of each list in turn until the
    text has at most `most` tokens, or nothing is left to cut but one finding; with `tokens`. Each list is walked once, however
    long it is."""
    names, out = tuple(CONTEXT_UNITS), rounds

    def units(name: str) -> Column:
        before, each = CONTEXT_UNITS[name]
        items = F.aggregate(name, F.lit(0), lambda n, x: n + F.coalesce(T.utf16_length(x) + each, F.lit(0)))
        return F.when(F.size(name) > 0, items + before).otherwise(0)

    for name, keep in CONTEXT_ORDER:
        before, each = CONTEXT_UNITS[name]
        rest = T.utf16_length(F.concat(F.lit("## Round  Context"), F.col("round").cast("string")))
        for other in names:
            rest = rest + (units(other) if other != name else 0)
        out = out.withColumn("rest", rest + before)
        begin = F.struct(F.lit(0).alias("n"), F.col("rest").alias("units"))
        fits = lambda a, x: a["units"] + F.coalesce(T.utf16_length(x) + each, F.lit(0))  # noqa: B023, E731  used at once
        taken = F.aggregate(name, begin, lambda a, x: F.struct((a["n"] + (fits(a, x) <= most * T.CHARS_PER_TOKEN).cast("int")).alias("n"), fits(a, x).alias("units")))["n"]  # noqa: B023
        out = out.withColumn(name, F.slice(F.col(name), F.lit(1), F.greatest(taken, F.least(F.size(name), F.lit(keep))))).drop("rest")
    return out.withColumn("tokens", T.estimate_tokens(context_text("round", *map(F.col, names))).cast("long"))

