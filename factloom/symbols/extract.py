"""A file's symbols by the language of its name, for tables of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from factloom.functions import text as T
from factloom.symbols import golang, patterns, pysource, rustlang, script

#: Extensions of the languages that are read whole, and of those read line by line.
TREES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".mts": "typescript", ".cts": "typescript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyi": "python", ".rs": "rust", ".go": "go",
}
LINES = {
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".swift": "swift", ".dart": "dart", ".lua": "lua", ".r": "r", ".R": "r",
}
READERS = {"python": pysource.extract, "go": golang.extract, "rust": rustlang.extract} | dict.fromkeys(("typescript", "tsx", "javascript", "jsx"), script.extract)

PARAMETERS = "array<struct<name:string,type:string,default_value:string,is_rest:boolean>>"
FUNCTION = f"struct<name:string,parameters:{PARAMETERS},return_type:string,type_parameters:array<string>,is_async:boolean,is_generator:boolean,visibility:string,decorators:array<string>,docstring:string,line:int,end_line:int>"
FIELDS = "array<struct<name:string,type:string,visibility:string,is_static:boolean,is_readonly:boolean>>"
CLASS = f"struct<name:string,type_parameters:array<string>,extends:array<string>,implements:array<string>,mixins:array<string>,fields:{FIELDS},methods:array<{FUNCTION}>,decorators:array<string>,docstring:string,visibility:string,line:int,end_line:int>"
EXPORTS = "array<struct<name:string,kind:string,is_re_export:boolean,source:string,is_type_only:boolean,line:int>>"
IMPORTS = "array<struct<source:string,specifiers:array<struct<name:string,alias:string,is_default:boolean,is_namespace:boolean>>,is_type_only:boolean,line:int>>"
CONSTANTS = "array<struct<name:string,type:string,value:string,is_exported:boolean,docstring:string,line:int>>"
#: What is known of a file.
AST = f"struct<language:string,parser_used:string,functions:array<{FUNCTION}>,classes:array<{CLASS}>,imports:{IMPORTS},exports:{EXPORTS},constants:{CONSTANTS},re_exports:{EXPORTS},line_count:int,parse_errors:array<struct<line:int,message:string>>>"


#: Files whose symbols are Python objects at once, and bytes of a batch that goes to a Python worker.
FILES, BATCH = 64, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python worker at once, for this session; its default of 64 MB is held several times over. A
    smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, BATCH)


def language_of(path: str) -> str | None:
    dot = path.rfind(".")
    return TREES.get(path[dot:]) or LINES.get(path[dot:]) if dot >= 0 else None


def supported(path) -> Column:
    """Whether symbols can be read from a file of that name."""
    return F.regexp_extract(T.col(path), r"(\.[^.]*)$", 1).isin(*TREES, *LINES)


def parse_file(path: str, content: str) -> dict:
    """Unknown kinds of files have an error and no symbols."""
    language = language_of(path)
    head = {"language": language or "unknown", "parser_used": "tree-sitter" if language in READERS else "regex", "line_count": content.count("\n") + 1}
    if language is None:
        return head | patterns.empty() | {"parse_errors": [{"line": 0, "message": "Unsupported file type"}]}
    return head | READERS.get(language, patterns.extract)(content, language)


def parse(files: DataFrame) -> DataFrame:
    """files(path, content) with `ast`, null where reading failed, and `warning`, which says why; one file's failure
    leaves the others alone. Null contents are not read. parser_used keeps the names of the two kinds of readers."""
    schema = StructType.fromDDL(f"ast {AST}, warning string")
    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def one(path, content):
            if path is None or content is None:
                return {"ast": None, "warning": None}
            try:
                return {"ast": parse_file(path, content), "warning": None}
            except Exception as e:  # whatever a hostile file does, the next one is read
                return {"ast": None, "warning": f"Failed to parse {path}: {e}"}

        for paths, contents in batches:
            # what is known of a file is held as Python objects for a few files at a time only
            parts = [pa.array([one(p.as_py(), c.as_py()) for p, c in zip(paths[i : i + FILES], contents[i : i + FILES], strict=True)], kind) for i in range(0, len(paths), FILES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    bound_batches(files.sparkSession)
    return files.withColumn("parsed", read("path", "content")).select(*files.columns, "parsed.ast", "parsed.warning")


def exports(parsed: DataFrame) -> DataFrame:
    """Exported symbols, one a row."""
    return parsed.select("path", F.explode("ast.exports").alias("e")).select("path", "e.*")


def imports(parsed: DataFrame) -> DataFrame:
    """Imports as module graphs read them: (src, specifier)."""
    return parsed.select(F.col("path").alias("src"), F.explode("ast.imports").alias("i")).select("src", F.col("i.source").alias("specifier"))


def totals(parsed: DataFrame) -> DataFrame:
    """Files, functions, classes, exports and imports of each language; the totals are their sums."""
    n = lambda c: F.coalesce(F.sum(F.size(f"ast.{c}")), F.lit(0)).alias(c)
    return parsed.filter("ast is not null").groupBy("ast.language").agg(F.count("*").alias("files"), *map(n, ("functions", "classes", "exports", "imports")))


def constant_case(name) -> Column:
    """F32: names in capitals."""
    return F.rlike(T.col(name), F.lit(r"^[A-Z][A-Z0-9_]*$"))


def by_case(name) -> Column:
    """F32: public by a capital initial."""
    return F.when(F.rlike(T.col(name), F.lit("^[A-Z]")), "public").otherwise("private")


def by_underscore(name) -> Column:
    """F32: __x__ public, __x private, _x protected."""
    n = T.col(name)
    return F.when(F.startswith(n, F.lit("__")) & F.endswith(n, F.lit("__")), "public").when(F.startswith(n, F.lit("__")), "private").when(F.startswith(n, F.lit("_")), "protected").otherwise("public")
