"""Dependencies from manifests; each reader takes files(path, content) and gives path, name, version, type."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Section of package.json to type of dependency.
PACKAGE_SECTIONS = {"dependencies": "production", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}
ROW = "array<struct<name string, version string, type string>>"


def package_json(files: DataFrame) -> DataFrame:
    """S3."""
    schema = ", ".join(f"`{s}` map<string, string>" for s in PACKAGE_SECTIONS)
    p = files.select("path", F.from_json("content", schema).alias("p"))
    out = [p.select("path", F.explode(F.col(f"p.{s}")).alias("name", "version"), F.lit(t).alias("type")) for s, t in PACKAGE_SECTIONS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


#: Lines that are no requirements, and what one looks like.
NOT_NEEDED = ("#", "-r", "-e", "-i", "--")
REQUIREMENT = r"^([a-zA-Z0-9_.-]+)\s*([><=!~]+.*)?"


def requirements(files: DataFrame) -> DataFrame:
    """Lines but comments and some flags; the version is what follows the name with a comparison, to the line's end, or *."""
    line = files.select("path", F.explode(F.split("content", "\n")).alias("l")).withColumn("l", T.unicode_trim("l"))
    for mark in NOT_NEEDED:
        line = line.filter(~F.startswith("l", F.lit(mark)))
    line = line.filter(F.rlike("l", F.lit(REQUIREMENT)))
    version = F.coalesce(F.nullif(T.unicode_trim(F.regexp_extract("l", REQUIREMENT, 2)), F.lit("")), F.lit("*"))
    return line.select("path", F.regexp_extract("l", REQUIREMENT, 1).alias("name"), version.alias("version"), F.lit("production").alias("type"))


def go_mod(files: DataFrame) -> DataFrame:
    """Pairs of words that begin a line of a require block, but comments; and single requirements."""
    pair, alone = r"(?m)^\s*(\S+)\s+(\S+)", r"(?m)^require[ \t]+(\S+)[ \t]+(\S+)"
    found = lambda text, p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("version"))
    blocks = F.transform(F.regexp_extract_all("content", F.lit(r"require\s*\(([\s\S]*?)\)"), F.lit(1)), lambda b: F.filter(found(b, pair), lambda d: ~F.startswith(d["name"], F.lit("//"))))
    rows = files.select("path", F.explode(F.concat(F.flatten(blocks), found(F.col("content"), alone))).alias("d"))
    return rows.select("path", "d.name", "d.version", F.lit("production").alias("type"))


def _toml(read):
    @F.pandas_udf(ROW)
    def parse(content: pd.Series) -> pd.Series:
        def one(text):
            try:
                return [dict(zip(("name", "version", "type"), x, strict=True)) for x in read(tomllib.loads(text or ""))]
            except tomllib.TOMLDecodeError:
                return None  # reported as a warning by the caller: no row for this file

        return content.map(one)

    return parse


def _cargo(doc):
    for section, kind in (("dependencies", "production"), ("dev-dependencies", "development"), ("build-dependencies", "development")):
        for name, v in doc.get(section, {}).items():
            yield name, v if isinstance(v, str) else str(v.get("version", "*")), kind


def _pyproject(doc):
    import re

    p = doc.get("project", {})
    for kind, specs in [("production", p.get("dependencies", [])), *(("development", g) for g in p.get("optional-dependencies", {}).values())]:
        for s in specs:
            if m := re.match(r"[a-zA-Z0-9_.-]+", str(s)):
                yield m[0], str(s), kind


def _exploded(files: DataFrame, parse) -> DataFrame:
    return files.select("path", F.explode(parse("content")).alias("d")).select("path", "d.name", "d.version", "d.type")


def cargo_toml(files: DataFrame) -> DataFrame:
    """S4."""
    return _exploded(files, _toml(_cargo))


def pyproject_toml(files: DataFrame) -> DataFrame:
    """The version is the whole specification."""
    return _exploded(files, _toml(_pyproject))


READERS = {"package.json": package_json, "Cargo.toml": cargo_toml, "go.mod": go_mod, "requirements.txt": requirements, "pyproject.toml": pyproject_toml}


def dependencies(files: DataFrame) -> DataFrame:
    """By file name."""
    out = None
    for name, read in READERS.items():
        got = read(files.filter(T.basename("path") == name))
        out = got if out is None else out.unionByName(got)
    return out
