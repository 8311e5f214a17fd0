"""Views behind reports: classes of files, tests and imports, roll-ups of rounds, and tables joined for reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Test frameworks by file name, first match wins (files of three JavaScript runners look alike and count for the first).
FRAMEWORKS = [("vitest", r"\.(?:test|spec)\.[tj]sx?$"), ("pytest", r"(?:^|/)test_[^/]*\.py$|_test\.py$"), ("go_test", r"_test\.go$"), ("rust_test", r"(?:^|/)tests/.*\.rs$")]

#: Kinds of tests by path; a file may be of several kinds, and is of the kind "other" only if of none.
TEST_KINDS = {"unit": r"/unit/|__tests__|\.(?:test|spec)\.[jt]sx?$", "integration": r"/integration/|/int/", "e2e": r"/(?:e2e|cypress|playwright)/"}

#: Words in names of folders that tell a layer, first match wins.
LAYERS = [
    "controller", "service", "model", "middleware", "route", "handler", "repository", "util", "helper", "lib", "core", "domain", "infrastructure", "presentation", "api",
    "view", "component", "store", "reducer", "action", "hook", "provider", "adapter", "gateway", "factory", "strategy", "command", "query", "event",
]

#: Providers of continuous integration by path, first match wins, and files of the same kind without a provider.
CI = [("GitHub Actions", r"\.github/workflows"), ("GitLab CI", r"\.gitlab-ci"), ("Jenkins", "Jenkinsfile"), ("CircleCI", r"\.circleci"), ("Travis CI", r"\.travis\.yml"), ("Azure Pipelines", "azure-pipelines")]
CONTAINERS = "dockerfile|docker-compose"

#: Documentation inside code, by extension.
INLINE_DOCS = [((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts"), r"(?s)/\*\*.*?\*/"), ((".py", ".pyi"), r"(?s)\"\"\".*?\"\"\"|'''.*?'''"), ((".rs",), r"///|//!")]

#: Least length and references of a round's text, and what counts as a path.
QUALITY = {1: (500, 3), 2: (500, 5), 3: (500, 5), 4: (500, 5), 5: (500, 5), 6: (200, 2)}
PATH = r"src/|[a-zA-Z0-9_-]+/[a-zA-Z0-9_.-]+\.\w+"


def first_of(rules: list[tuple[str, str]], value, flags: str = "") -> Column:
    """The name of the first pattern that value matches, else null."""
    return F.coalesce(*(F.when(F.rlike(value, F.lit(flags + p)), F.lit(name)) for name, p in rules))


def framework(path) -> Column:
    """P13."""
    return first_of(FRAMEWORKS, path)


def layer(path) -> Column:
    """The layer that the name of a folder tells, or null."""
    name = F.lower(T.basename(path))
    return F.coalesce(*(F.when(F.contains(name, F.lit(k)), F.lit(k)) for k in LAYERS))


def ci_provider(path) -> Column:
    """P18."""
    return first_of(CI, path, "(?i)")


def ci_files(files: DataFrame) -> DataFrame:
    """Files of continuous integration and containers, with the provider where there is one."""
    return files.filter(ci_provider("path").isNotNull() | F.rlike("path", F.lit(f"(?i){CONTAINERS}"))).select("path", ci_provider("path").alias("provider"))


def tests_by_framework(files: DataFrame) -> DataFrame:
    """Files and tests of each framework; files(path, tests)."""
    return files.withColumn("framework", framework("path")).filter("framework is not null").groupBy("framework").agg(F.count("*").alias("files"), F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"))


def test_kinds(files: DataFrame) -> DataFrame:
    """Files and tests of each kind; a file counts in every kind it is of. files(path, tests)."""
    hits = {k: F.rlike("path", F.lit(p)) for k, p in TEST_KINDS.items()}
    other = ~reduce(lambda a, b: a | b, hits.values())
    kinds = F.filter(F.array(*(F.when(h, F.lit(k)) for k, h in hits.items()), F.when(other, F.lit("other"))), lambda k: k.isNotNull())
    return files.select(F.explode(kinds).alias("kind"), "tests").groupBy("kind").agg(F.count("*").alias("files"), F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"))


def import_classes(imports: DataFrame) -> DataFrame:
    """Imports of each class; imports(specifier)."""
    return imports.groupBy(T.import_class("specifier").alias("class")).agg(F.count("*").alias("imports"))


def most_imported(imports: DataFrame, n: int = 20) -> DataFrame:
    """Raw specifiers by the number of imports, not of distinct files; imports(specifier, seq)."""
    return imports.groupBy("specifier").agg(F.count("*").alias("imports"), F.min("seq").alias("seq")).orderBy(F.desc("imports"), "seq", "specifier").limit(n).select("specifier", "imports")


def files_by_top_dir(files: DataFrame, n: int = 20) -> DataFrame:
    """Files below each folder of the first level, the fullest first; files(path)."""
    return files.groupBy(T.top_dir("path").alias("dir")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir").limit(n)


def locations(refs: DataFrame, n: int) -> DataFrame:
    """Each variable with the number of its references and the first n as file:line; refs(variable, file, line).

    Only n references of a variable are ever gathered, whatever their number.
    """
    total = refs.groupBy("variable").agg(F.count("*").alias("refs"))
    order = Window.partitionBy("variable").orderBy("file", "line")
    few = refs.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)
    at = F.struct("k", F.concat_ws(":", "file", "line").alias("at"))
    listed = few.groupBy("variable").agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["at"]).alias("locations"))
    return total.join(listed, "variable")


def inline_doc_coverage(files: DataFrame, n: int = 100) -> DataFrame:
    """Integer percent, halves up, of the first n files by path whose language has inline documentation."""
    ext = T.extname("path")
    known = files.filter(ext.isin([e for group, _ in INLINE_DOCS for e in group]))
    has = F.coalesce(*(F.when(ext.isin(list(group)), F.rlike("content", F.lit(p))) for group, p in INLINE_DOCS))
    some = known.orderBy("path").limit(n).select(F.coalesce(has, F.lit(False)).cast("int").alias("has"))
    return some.agg(F.count("*").alias("sampled"), F.coalesce(F.sum("has"), F.lit(0)).alias("documented")).withColumn("percent", F.when(F.col("sampled") > 0, F.floor(100 * F.col("documented") / F.col("sampled") + 0.5)).otherwise(0).cast("int"))


def round_table(results: DataFrame, rounds: int = 6) -> DataFrame:
    """One row for each round, those without a result skipped; results(round, status, validated, corrected), one row a round."""
    every = results.sparkSession.range(1, rounds + 1).select(F.col("id").alias("round"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("validated", "corrected")]
    return every.join(results, "round", "left").select("round", F.coalesce("status", F.lit("skipped")).alias("status"), *zero)


def conventions(found: DataFrame) -> DataFrame:
    """Patterns found twice or more, with the description seen first; found(module, pattern, description, seq)."""
    total = found.agg(F.countDistinct("module").alias("modules"))
    n = found.groupBy(T.unicode_trim(F.lower("pattern")).alias("pattern")).agg(F.count("*").alias("n"), F.min_by("description", "seq").alias("description")).filter("n >= 2")
    return n.crossJoin(F.broadcast(total)).select("pattern", "description", F.format_string("Found in %d of %d modules", "n", "modules").alias("frequency"))  # one row


def severities(cases: DataFrame) -> DataFrame:
    """Critical, warning and other edge cases in one row; cases(severity)."""
    is_ = lambda v: F.coalesce(F.col("severity") == v, F.lit(False))
    return cases.agg(F.count_if(is_("critical")).alias("critical"), F.count_if(is_("warning")).alias("warning"), F.count_if(~is_("critical") & ~is_("warning")).alias("info"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, documents and the sorted types of an index; chunks(doc_id, doc_type)."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.array_sort(F.collect_set("doc_type")).alias("types"))


def quality(outputs: DataFrame) -> DataFrame:
    """2.13, F33: whether a round's text is long, specific and names a path; outputs(round, text)."""
    lengths, refs = (F.coalesce(*(F.when(F.col("round") == k, F.lit(v[i])) for k, v in QUALITY.items()), F.lit(QUALITY[5][i])) for i in (0, 1))
    n, length = T.references("text"), T.utf16_length("text")
    ok = (length >= lengths) & (n >= refs) & F.rlike("text", F.lit(PATH))
    return outputs.withColumns({"references": n, "specificity": T.specificity("text"), "acceptable": F.coalesce(ok, F.lit(False))})


def terminal(rounds: DataFrame, deps: DataFrame) -> DataFrame:
    """Registered rounds that no other registered round needs; rounds(round), deps(round, needs)."""
    needed = deps.join(rounds, "round", "left_semi").select(F.col("needs").alias("round"))
    return rounds.join(needed, "round", "left_anti")


def with_role(deps: DataFrame, roles: DataFrame) -> DataFrame:
    """Dependencies with their role, '-' where none is known; of several the last holds. roles(name, role, seq)."""
    last = roles.groupBy("name").agg(F.max_by("role", "seq").alias("role"))
    group = F.when(F.col("type").isin("peer", "optional"), "peer").otherwise(F.col("type"))
    return deps.join(last, "name", "left").withColumns({"role": F.coalesce("role", F.lit("-")), "section": group})


def annotated(dirs: DataFrame, modules: DataFrame) -> DataFrame:
    """Folders with the purpose of the module at the same path; modules(path, purpose), one row a path."""
    return dirs.join(modules.select("path", "purpose"), "path", "left")


def config_diff(own: DataFrame, defaults: DataFrame) -> DataFrame:
    """Keys missing, customized, at their default or unknown; both (key, value). A null value is a value."""
    a, b = own.select("key", F.col("value").alias("current"), F.lit(True).alias("in_own")), defaults.select("key", F.col("value").alias("default"), F.lit(True).alias("known"))
    action = F.when(F.col("in_own").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.expr("current <=> default"), "at-default").otherwise("customized")
    return a.join(b, "key", "full").select("key", "current", "default", action.alias("action"))


def reindex_plan(docs: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Documents to index again and to skip, by fingerprint; both (doc_id, fingerprint)."""
    old = stored.select("doc_id", F.col("fingerprint").alias("old"))
    again = F.lit(force) | ~F.expr("old <=> fingerprint")
    return docs.join(old, "doc_id", "left").withColumn("action", F.when(again, "index").otherwise("skip")).drop("old")


def cached_rounds(keys: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """I8: rounds with what the cache holds for the same key and version; keys(round, hash), cache(round, hash, version, result).

    A key covers the results of earlier rounds, so a round that changes makes those after it miss.
    """
    held = cache.filter(F.col("version") == version).select("round", "hash", "result").dropDuplicates(["round", "hash"])
    return keys.join(held, ["round", "hash"], "left").withColumn("hit", F.col("result").isNotNull())


def affected_by(degraded: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that need a degraded round, with these; degraded(round), docs(doc, rounds)."""
    hit = docs.select("doc", F.explode("rounds").alias("round")).join(degraded, "round", "left_semi")
    return hit.groupBy("doc").agg(F.array_sort(F.collect_set("round")).alias("rounds"))
