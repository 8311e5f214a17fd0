"""Which files are manifests, documents or infrastructure, and which rows of facts a view takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.incremental import glob_regex

#: Names of manifests, folders and extensions of documentation, and paths that every document depends on.
MANIFESTS = ("package.json", "Cargo.toml", "go.mod", "requirements.txt", "pyproject.toml")
DOC_FOLDERS = ("docs", "doc", "documentation", "wiki", ".github")
DOC_EXTENSIONS = (".md", ".txt", ".rst", ".adoc")
INFRASTRUCTURE = ("src/utils/**", "src/config/loader.ts", "src/config/defaults.ts", "src/config/schema.ts", "src/domain/types.ts", "src/domain/entities.ts", "**/types.ts")
#: Kinds of remarks that count as edge cases.
EDGE_KINDS = ("bugs", "debt")


def is_manifest(path) -> Column:
    """P4."""
    return T.basename(path).isin(*MANIFESTS)


def is_env_file(path) -> Column:
    """P5."""
    return F.startswith(T.basename(path), F.lit(".env"))


def is_readme(path) -> Column:
    """P6."""
    return F.rlike(T.basename(path), F.lit(r"(?i)^readme(\.(md|txt|rst|adoc))?$"))


def doc_folder(files: DataFrame) -> DataFrame:
    """The first folder of documentation in the order of paths, one row or none."""
    return files.select(T.top_dir("path").alias("folder"), "path").filter(F.col("folder").isin(*DOC_FOLDERS) & F.contains("path", F.lit("/"))).orderBy("path").limit(1).select("folder")


def doc_files(files: DataFrame) -> DataFrame:
    """Files below the folder of documentation, and files of its kinds anywhere."""
    folder = doc_folder(files).agg(F.max("folder").alias("folder"))  # one row, null without such a folder
    return files.crossJoin(F.broadcast(folder)).filter((T.top_dir("path") == F.col("folder")) | F.lower(T.extname("path")).isin(*DOC_EXTENSIONS)).drop("folder")


def is_infrastructure(path, globs: tuple = INFRASTRUCTURE) -> Column:
    """P14."""
    return F.rlike(path, F.lit("|".join(f"(?:{glob_regex(g)})" for g in globs)))


def by_output(changes: DataFrame, output: str) -> tuple[DataFrame, DataFrame]:
    """Changed sources, and what was generated again below the output folder."""
    inside = F.startswith("path", F.lit(output + "/"))
    return changes.filter(~inside), changes.filter(inside)


def required(variables: DataFrame, wanted: bool = True) -> DataFrame:
    """P25: variables(required)."""
    return variables.filter(F.coalesce("required", F.lit(False)) == wanted)


def edge_remarks(todos: DataFrame) -> DataFrame:
    """todos(category)."""
    return todos.filter(F.col("category").isin(*EDGE_KINDS))


def included(packed: DataFrame) -> DataFrame:
    """Packed files that prompts hold."""
    return packed.filter("tier != 'skip'")


def of_modules(packed: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, path) of the files below each module's path; of modules without one, the files that equal or begin with
    one of those it lists. packed(path), modules(module, path, files).

    A path meets its own ancestors by equality, so nothing is compared with every module; listed files are met as prefixes
    of any length by the ancestors of a path and by the path itself, and prefixes that end inside a name by their folder.
    """
    up = F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), "/"))
    steps = packed.select("path", F.split("path", "/").alias("p")).select("path", F.explode(up).alias("at"))
    below = steps.join(modules.select("module", F.col("path").alias("at")), "at").select("module", "path").distinct()
    rest = modules.join(below.select("module").distinct(), "module", "left_anti").select("module", F.explode("files").alias("file")).withColumn("at", T.dirname("file"))
    folder = packed.select("path", F.split("path", "/").alias("p")).select("path", F.explode(F.concat(F.array(F.lit("")), up)).alias("at"))
    listed = folder.join(rest, "at").filter(F.startswith("path", F.col("file"))).select("module", "path").distinct()
    return below.unionByName(listed)


def exported_symbols(parsed: DataFrame) -> DataFrame:
    """Functions and classes whose names are exported, classes with their public methods only; parsed(path, ast)."""
    names = F.transform("ast.exports", lambda e: e["name"])
    row = lambda kind: F.transform(F.filter(f"ast.{kind}", lambda s: F.array_contains(names, s["name"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["name"].alias("name"), *(
        [F.transform(F.filter(s["methods"], lambda m: m["visibility"] == "public"), lambda m: m["name"]).alias("methods")] if kind == "classes" else [F.array().cast("array<string>").alias("methods")])))
    return parsed.filter("ast is not null").select("path", F.explode(F.concat(row("functions"), row("classes"))).alias("s")).select("path", "s.*")
