"""Files of a folder, and facts of git as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.incremental import glob_regex

#: Largest file, extensions of binary files, folders that are never read.
MAX_BYTES = 2 * 1024 * 1024
BINARY = "png jpg jpeg gif bmp ico svg woff woff2 ttf eot otf mp4 mp3 avi mov webm wav pdf zip tar gz rar 7z exe dll so dylib wasm o obj pyc class".split()
IGNORED = "node_modules .git dist build coverage .next __pycache__ target vendor".split()


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """A .gitignore as (regular expression, whether it ignores) in order; a later rule that matches overrules earlier ones."""
    out = []
    for line in text.split("\n"):
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r"))
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line.removeprefix("\\")
        anchored = "/" in line.rstrip("/")
        body = glob_regex(line.strip("/"))[1:-1]
        out.append(((r"^" if anchored else r"(?:^|.*/)") + body + ("/.*$" if line.endswith("/") else "(?:/.*)?$"), not keep))
    return out


def ignored(path, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches ignores the path."""
    return F.coalesce(*(F.when(F.rlike(path, F.lit(p)), F.lit(no)) for p, no in reversed(rules)), F.lit(False))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, also of a hidden one, which readers of tables pass over; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def discover(spark: SparkSession, root: str, ignore: list[str] = (), contents: bool = True) -> DataFrame:
    """Text files up to 2 MiB below root in order of their paths, without hidden ones and those that ignore files
    name, with their contents; ignore: more globs. See `tree`."""
    from factloom.sources import tree

    found = tree.scan(spark, root, ignore, contents).filter("warning is null").drop("warning")
    return found.withColumn("content", F.decode("content", "UTF-8")).orderBy(F.collate("path", "UNICODE"), "path")


def git_log(lines: DataFrame) -> DataFrame:
    """Value as hash|author|email|date|message; the message may hold bars."""
    p = F.split("value", r"\|", 5)
    return lines.filter("value != ''").select(*(p[i].alias(n) for i, n in enumerate(("hash", "author", "email", "date", "message"))))


def git_refs(lines: DataFrame) -> DataFrame:
    """Value as name|date."""
    p = F.split("value", r"\|", 2)
    return lines.filter("value != ''").select(p[0].alias("name"), F.to_timestamp(p[1]).alias("commit_ts"))


def change_set(parts: list[DataFrame]) -> DataFrame:
    """Paths of a diff and of the working tree's states, each once."""
    out = parts[0].select("path")
    for p in parts[1:]:
        out = out.unionByName(p.select("path"))
    return out.distinct()
