"""2.17: what rounds of analysis get to read: facts of several tables as lines of text in order, fitted to a budget.

A brief is a table (section, place, part, line). Lists are top lists by design: they name the first so many and, where a list
is cut inside an entry, how many more there are. Facts come as tables by name; sections whose table is not there are left
out, and so are the titles of sections without lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import facts as A
from factloom.operators import predicates, reports, rounds

#: Lengths of lists, by what they list.
EXTENSIONS, LARGEST, DEPENDENCIES, COMMITS, PEOPLE, FOLDERS = 15, 10, 30, 10, 10, 50
IMPORTERS, IMPORTS_2, IMPORTS_3, IMPORTED, EXPORTERS_2, EXPORTERS_3, EXPORTS_2, EXPORTS_3 = 40, 10, 8, 20, 20, 30, 5, 10
MODULE_FILES, MODULE_API, TESTS, FEATURES, LAYERS, TOP_FOLDERS = 20, 10, 30, 20, 30, 20
SOURCES, NAMES, REMARKS, MODULE_TESTS = 20, 10, 15, 10
VARIABLES, REFERENCED, SPOTS, PRODUCTION = 30, 30, 5, 15


def text(*parts) -> Column:
    """Columns by name in braces and literal text, as one string; a null part is empty."""
    return F.concat(*(F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if isinstance(p, str) and p.startswith("{") else F.lit(p) if isinstance(p, str) else p for p in parts))


def lines(number: int, place, part, line) -> list[Column]:
    return [F.lit(number).alias("section"), place.cast("int").alias("place"), part.cast("int").alias("part"), line.alias("line")]


def first(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first rows in order, with their place from 1."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # `limit` rows


def titled(number: int, title: str, top: DataFrame, line: Column) -> DataFrame:
    """The lines of rows with places, below a title if there are any."""
    return top.select(*lines(number, F.col("place"), F.lit(0), line)).unionByName(top.limit(1).select(*lines(number, F.lit(0), F.lit(0), F.lit(title))))


def nested(number: int, title: str, rows: DataFrame, entries: int, items: int, head: Column, item: Column) -> DataFrame:
    """Of rows(key, item, seq) the keys with most items, each with its first items and how many more it has."""
    top = first(rows.groupBy("key").agg(F.count("*").alias("n")), entries, F.desc("n"), "key")
    few = rows.join(F.broadcast(top), "key").withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("seq", "item"))).filter(F.col("k") <= items)  # `entries` rows
    more = top.filter(F.col("n") > items).select(*lines(number, F.col("place"), F.lit(items + 1), F.concat(F.lit("    and "), (F.col("n") - items).cast("string"), F.lit(" more"))))
    return titled(number, title, top, head).unionByName(few.select(*lines(number, F.col("place"), F.col("k"), item))).unionByName(more)


def heads(rows: DataFrame, entries: int, items: int, *order) -> DataFrame:
    """Of rows(key, item, seq) the first keys in order of `n` items, or of `seq`, their first: with n, seq, place and `shown`, the
    first items and how many more there are."""
    top = first(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("seq").alias("seq")), entries, *order)
    few = rows.join(F.broadcast(top.select("key")), "key").withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("seq", "item"))).filter(F.col("k") <= items)  # `entries` rows
    listed = few.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("few"))
    more = F.when(F.col("n") > items, F.concat(F.lit(" and "), (F.col("n") - items).cast("string"), F.lit(" more"))).otherwise("")
    return top.join(listed, "key").withColumn("shown", F.concat(F.array_join("few", ", "), more))


def few_of(names: Column, n: int, sep: str = ", ") -> Column:
    """The first names of an array, and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, n), sep), F.when(F.size(names) > n, F.concat(F.lit(" and "), (F.size(names) - n).cast("string"), F.lit(" more"))).otherwise(""))


def brief(*sections: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, [s for s in sections if s is not None])


def fitted(lines_: DataFrame, budget: int) -> DataFrame:
    """the lines of a brief, in order, as long as their tokens fit, with the tokens so far. A brief is bounded by its lists."""
    so_far = F.sum(T.estimate_tokens("line") + 1).over(Window.orderBy("section", "place", "part", "line"))
    return lines_.withColumn("tokens", so_far).filter(F.col("tokens") <= budget)


def _has(facts: dict, name: str, make) -> DataFrame | None:
    return make(facts[name]) if facts.get(name) is not None else None


def overview(facts: dict[str, DataFrame]) -> DataFrame:
    """Round 1. files(path, size, lines), deps(name, version, type, seq), commits(hash, message, author, date, seq),
    people(name, commits), docs(path)."""
    files = facts["files"]
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).crossJoin(A.ancestors(files).agg(F.count("*").alias("folders")))  # one row each
    counts = total.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), text(f"{n}: ", f"{{{n}}}").alias("line")) for i, n in enumerate(("files", "folders", "lines"), 1)))).alias("x")).select("x.*")
    kinds = A.by_extension(files.select(T.extname("path").alias("extension")))
    return brief(
        titled(1, "# Size", counts, F.col("line")), titled(2, "# Extensions", first(kinds, EXTENSIONS, F.desc("files"), "extension"), text("  ", "{extension}", ": ", "{files}")),
        titled(3, "# Largest files", first(files, LARGEST, F.desc("size"), "path"), text("  ", "{path}", ": ", "{lines}", " lines, ", "{size}", " bytes")),
        _has(facts, "deps", lambda d: titled(4, "# Dependencies", first(d, DEPENDENCIES, "seq"), text("  ", "{name}", "@", "{version}", " (", "{type}", ")"))),
        _has(facts, "commits", lambda c: titled(5, "# Latest commits", first(c, COMMITS, "seq"), text("  ", F.substring("hash", 1, 7), " ", "{message}", " (", "{author}", ", ", "{date}", ")"))),
        _has(facts, "people", lambda c: titled(6, "# Contributors", first(c, PEOPLE, F.desc("commits"), "name"), text("  ", "{name}", ": ", "{commits}"))),
        _has(facts, "docs", lambda d: titled(7, "# Documentation", d.agg(F.count("*").alias("n"), F.count_if(predicates.is_readme("path")).alias("readmes")).withColumn("place", F.lit(1)), text("  ", "{n}", " documents, ", "{readmes}", " of them readmes"))),
    )


def _imports(number: int, imports: DataFrame, items: int) -> DataFrame:
    return nested(number, "# Imports of files", imports.select(F.col("path").alias("key"), F.col("source").alias("item"), "seq"), IMPORTERS, items, text("  ", "{key}", ":"), text("    ", "{item}"))


def _exports(number: int, exports: DataFrame, entries: int, names: int) -> DataFrame:
    top = heads(exports.select(F.col("path").alias("key"), F.col("name").alias("item"), "seq"), entries, names, F.desc("n"), "key")
    return titled(number, "# Exports of files", top, text("  ", "{key}", ": ", "{shown}"))


def modules(facts: dict[str, DataFrame]) -> DataFrame:
    """Round 2. files(path), parsed(path, language), imports(path, source, seq), exports(path, name, seq)."""
    imported = facts["imports"].groupBy("source").agg(F.count("*").alias("n"))
    return brief(
        titled(1, "# Languages", first(facts["parsed"].groupBy("language").agg(F.count("*").alias("n")), 1000, F.desc("n"), "language"), text("  ", "{language}", ": ", "{n}", " files")),
        titled(2, "# Folders", first(A.ancestors(facts["files"]), FOLDERS, "dir"), text("  ", "{dir}", "/ (", "{children}", ")")),
        _imports(3, facts["imports"], IMPORTS_2), titled(4, "# Most imported", first(imported, IMPORTED, F.desc("n"), "source"), text("  ", "{source}", ": ", "{n}")), _exports(5, facts["exports"], EXPORTERS_2, EXPORTS_2),
    )


def features(facts: dict[str, DataFrame]) -> DataFrame:
    """Round 3. modules(seq, name, path, purpose, files), entries(seq, path, type, description), exports, imports, tests(path,
    framework, tests, seq)."""
    every = facts["modules"]
    shown = text("  ", "{name}", " (", "{path}", "): ", "{purpose}", "; ", few_of(F.col("files"), MODULE_FILES))
    return brief(
        titled(1, "# Modules", first(every, 1000, "seq"), shown), _has(facts, "entries", lambda e: titled(2, "# Entry points", first(e, 1000, "seq"), text("  ", "{path}", " (", "{type}", "): ", "{description}"))),
        _exports(3, facts["exports"], EXPORTERS_3, EXPORTS_3), _imports(4, facts["imports"], IMPORTS_3), _has(facts, "tests", lambda t: titled(5, "# Tests", first(t, TESTS, "seq"), text("  ", "{path}", " (", "{framework}", ", ", "{tests}", ")"))),
    )


def architecture(facts: dict[str, DataFrame]) -> DataFrame:
    """Round 4. relationships(seq, a, b, type, evidence), modules(seq, name, path, purpose, api), flows(seq, name, path,
    description), features(seq, name, description, modules), imports(source), files(path)."""
    kinds = reports.import_classes(facts["imports"].select(F.col("source").alias("specifier")))
    dirs = A.ancestors(facts["files"]).select("dir", reports.layer("dir").alias("layer")).filter("layer is not null")
    tops = facts["files"].groupBy(T.top_dir("path").alias("top")).agg(F.count("*").alias("n"))
    return brief(
        _has(facts, "relationships", lambda r: titled(1, "# Links of modules", first(r, 1000, "seq"), text("  ", "{a}", " -> ", "{b}", " (", "{type}", "): ", "{evidence}"))),
        _has(facts, "modules", lambda m: titled(2, "# Modules", first(m, 1000, "seq"), text("  ", "{name}", " (", "{path}", "): ", "{purpose}", F.when(F.size("api") > 0, F.concat(F.lit("; "), few_of(F.col("api"), MODULE_API))).otherwise("")))),
        _has(facts, "flows", lambda f: titled(3, "# Flows", first(f, 1000, "seq"), text("  ", "{name}", ": ", F.array_join("path", " -> "), "; ", "{description}"))),
        _has(facts, "features", lambda f: titled(4, "# Features", first(f, FEATURES, "seq"), text("  ", "{name}", ": ", "{description}", " [", F.array_join("modules", ", "), "]"))),
        titled(5, "# Kinds of imports", first(kinds, 10, F.desc("imports"), "class"), text("  ", "{class}", ": ", "{imports}")), titled(6, "# Folders named like layers", first(dirs, LAYERS, "dir"), text("  ", "{dir}", " (", "{layer}", ")")),
        titled(7, "# Files by folder", first(tops, TOP_FOLDERS, F.desc("n"), "top"), text("  ", "{top}", "/: ", "{n}")),
    )


def edge_cases(facts: dict[str, DataFrame]) -> DataFrame:
    """Round 5: a brief of each module, all at once, with a column `module`. modules(module, path, files), parsed(path, functions,
    exports), todos(path, line, marker, text, seq), tests(path, framework, tests, seq)."""
    mods, of = facts["modules"], Window.partitionBy("module")

    def part(number: int, title: str, rows: DataFrame, limit: int, line: Column, *order) -> DataFrame:
        top = rows.withColumn("place", F.row_number().over(of.orderBy(*order))).filter(F.col("place") <= limit)
        shown = top.select("module", *lines(number, F.col("place"), F.lit(0), line))
        return shown.unionByName(shown.filter("place = 1").select("module", *lines(number, F.lit(0), F.lit(0), F.lit(title))))

    names = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"; {label}: "), F.array_join(F.slice(c, 1, NAMES), ", "))).otherwise("")
    head = mods.withColumn("n", F.size("files"))
    return brief(
        part(1, "# Module", head, 1, text("  ", "{module}", " (", "{path}", "): ", "{n}", " files"), "path"), part(2, "# Sources", rounds.module_files(mods, facts["parsed"]), SOURCES, text("  ", "{path}", names("functions", "functions"), names("exports", "exports")), "path"),
        part(3, "# Remarks", rounds.module_files(mods, facts["todos"]), REMARKS, text("  ", "{marker}", " ", "{text}", " (", "{path}", ":", "{line}", ")"), "seq"),
        part(4, "# Tests", rounds.module_tests(mods, facts["tests"]), MODULE_TESTS, text("  ", "{path}", " (", "{framework}", ", ", "{tests}", ")"), "seq"),
    )


def deployment(facts: dict[str, DataFrame]) -> DataFrame:
    """Round 6. env_files(path, variables), env_refs(variable, file, line, seq), files(path), packed(path, rank, tier, content),
    deps(path, manager, name, version, type, seq). Contents are cut to rounds.CONFIG_CHARS characters."""
    refs = heads(facts["env_refs"].select(F.col("variable").alias("key"), text("{file}", ":", "{line}").alias("item"), "seq"), REFERENCED, SPOTS, "seq", "key")
    found = first(reports.ci_files(facts["files"]), 1000, "path")
    content = rounds.config_contents(found.select(F.col("path").alias("file")), facts["packed"])
    shown = found.join(content.withColumnRenamed("file", "path"), "path", "left")
    prod = facts["deps"].filter("type = 'production'").select(F.concat_ws("", F.col("path"), F.lit(" ("), F.coalesce("manager", F.lit("unknown")), F.lit(")")).alias("key"), F.concat_ws("@", "name", "version").alias("item"), "seq")
    return brief(
        titled(1, "# Env files", first(facts["env_files"], 1000, "path"), text("  ", "{path}", ": ", few_of(F.col("variables"), VARIABLES))), titled(2, "# Variables in code", refs, text("  ", "{key}", ": ", "{shown}")),
        titled(3, "# Build and deployment files", shown, text("  ", "{path}", F.coalesce(F.concat(F.lit(" ("), F.col("provider"), F.lit(")")), F.lit("")))),
        shown.filter("content is not null").select(*lines(3, F.col("place"), F.lit(1), F.col("content"))), nested(4, "# Production dependencies", prod, 1000, PRODUCTION, text("  ", "{key}"), text("    ", "{item}")),
    )
