"""What a set of changed files affects, document selection, validation of claims, and usage."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.written import Work


def affected(changed: DataFrame, claims: DataFrame, infra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renderers with the changed files they read, and changed files that none reads; files of infra do not count.
    Any unclaimed file means that everything is rendered again."""
    own = changed.join(infra, "path", "left_anti")
    hit = own.join(claims, "path").groupBy("renderer").agg(F.sort_array(F.collect_set("path")).alias("reasons"))
    return hit, own.join(claims, "path", "left_anti")


def stale(hit: DataFrame, docs: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Documents of affected renderers that were not generated again."""
    return docs.join(hit, "renderer").join(regenerated, "filename", "left_anti")


def dry_run(registry: DataFrame, hit: DataFrame, unclaimed: DataFrame, index: str = "index") -> DataFrame:
    """What would be done with each document."""
    every = unclaimed.agg((F.count("*") > 0).alias("every"))
    return registry.join(hit, "renderer", "left").crossJoin(F.broadcast(every)).select("renderer", F.when((F.col("renderer") == index) | F.col("every") | F.col("reasons").isNotNull(), "execute").otherwise("skip").alias("decision"))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if not c.isalnum() and c not in "/_-" else c)), i + 1
    return f"^{out}$"


#: Characters of a glob's literal end by which paths find it; rows of the result that one tile makes, and paths that it has.
TAIL, ROWS, SIDE = 4, 1 << 22, 512


def glob_key(glob: str) -> tuple[str, str]:
    """The literal folder up to the first wildcard, and the end by which paths find the glob: a slash and the whole name if the
    glob fixes it, else the last characters behind the last wildcard."""
    parts = re.split(r"[*?]", glob)
    end = parts[-1].rpartition("/")[2]
    before = glob[: len(glob) - len(parts[-1])]  # x**/y matches xy too, so that its name is not fixed
    fixed = len(parts) == 1 or "/" in parts[-1][1:] or parts[-1][:1] == "/" and (not before.endswith("**") or before in ("**", "/**") or before.endswith("/**"))
    return parts[0].rpartition("/")[0], "/" + end if fixed else end[-TAIL:]


def match_globs(globs: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path) of the files(path) that each of globs(name, glob) matches, once.

    An index of the distinct globs by their literal folder, up to the first wildcard, and their name or the literal end behind
    the last one: a path probes it by equality with each of its folders and ends, and only globs that it finds meet it as
    regular expressions, once each, however many names a glob has. The names are joined to what their globs found in tiles of
    about ROWS rows of the result, of SIDE paths: a path is sent once for each ROWS / SIDE names of its glob, a name once for
    each SIDE paths, and each name of a tile gives the same paths in the same order, which a writer stores as repeats. One scan
    of files, however many globs there are. Null globs and paths match nothing.
    """
    @F.arrow_udf("struct<folder string, tail string, regex string>")
    def read(values: pa.Array) -> pa.Array:
        keys = [(*glob_key(g), glob_regex(g)) for g in values.to_pylist()]
        return pa.array([dict(zip(("folder", "tail", "regex"), k, strict=True)) for k in keys], pa.struct([("folder", pa.string()), ("tail", pa.string()), ("regex", pa.string())]))

    work = Work(globs.sparkSession, "globs")
    named = work.table(globs.filter("glob is not null").select("name", "glob").distinct(), "named")
    index = named.select("glob").distinct().select("glob", read("glob").alias("g")).select("glob", "g.*")
    deep = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(deep) - 1), lambda n: F.array_join(F.slice(deep, F.lit(1), n), "/"))
    tails = F.concat(F.array(F.concat(F.lit("/"), F.element_at(deep, -1))), F.transform(F.sequence(F.lit(0), F.lit(TAIL)), lambda n: F.when(n > 0, F.right("path", n)).otherwise("")))
    probes = files.select("path").filter("path is not null").distinct().select("path", F.explode(F.array_distinct(folders)).alias("folder")).select("path", "folder", F.explode(F.array_distinct(tails)).alias("tail"))
    hits = work.table(probes.join(index, ["folder", "tail"]).filter(F.rlike("path", F.col("regex"))).select("glob", "path"), "hits")
    sizes = named.groupBy("glob").agg(F.count("*").alias("names")).join(hits.groupBy("glob").agg(F.count("*").alias("paths")), "glob")
    n = F.col("names") * F.col("paths")
    across, down = F.least("names", F.ceil(F.col("names") * F.least("paths", F.lit(SIDE)) / ROWS)), F.ceil(F.col("paths") / SIDE)
    sizes = work.table(sizes.select("glob", F.monotonically_increasing_id().alias("g"), n.alias("n"), across.alias("across"), down.alias("down")), "sizes")
    parts = -(-(sizes.agg(F.sum("n")).first()[0] or 1) // ROWS)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    tiled = lambda rows: rows.withColumn("tile", F.col("i") * F.col("down") + F.col("j")).drop("i", "j", "down").repartition(parts, "g", "tile")
    own = named.withColumn("several", F.count("*").over(Window.partitionBy("name")) > 1).join(sizes, "glob")
    own = tiled(own.select("name", "several", "g", "down", F.pmod(F.xxhash64("name"), "across").alias("i"), every("down").alias("j")))
    found = tiled(hits.join(sizes, "glob").select("path", "g", "down", F.pmod(F.xxhash64("path"), "down").alias("j"), every("across").alias("i")))
    of = lambda names: names.hint("merge").join(found, ["g", "tile"]).select("name", "path")
    return of(own.filter("not several")).unionByName(of(own.filter("several")).distinct())  # a name's only glob finds a path once


def expand_globs(globs: list[tuple[str, str]], files: DataFrame) -> DataFrame:
    """(renderer, path) of the files that each glob matches."""
    listed = files.sparkSession.createDataFrame(globs, "name string, glob string")
    return match_globs(listed, files).withColumnRenamed("name", "renderer")


def resolve_aliases(tokens: DataFrame, aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """Token to documents, by group or by alias; doc is null for unknown tokens. aliases(alias, doc), groups(name, alias)."""
    t = tokens.select("token", F.lower(F.trim("token")).alias("k"))
    wide = t.join(groups.select(F.col("name").alias("k"), "alias"), "k", "left").select("token", F.coalesce("alias", "k").alias("alias"))
    return wide.join(aliases, "alias", "left").select("token", "doc").distinct()


def validate(claims: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """Claims with `held`."""
    return claims.join(facts.select(*key).distinct().withColumn("held", F.lit(True)), key, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def validation_summary(checked: DataFrame) -> DataFrame:
    """Drop rate 0 without claims."""
    n = checked.agg(F.count_if("held").alias("validated"), F.count_if(~F.col("held")).alias("corrected"), F.count("*").alias("total"))
    return n.withColumn("drop_rate", F.coalesce(F.try_divide(F.col("corrected").cast("double"), F.col("total")), F.lit(0.0)))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(model, input, output, cache_read, cache_write) at its model's price, or that of 'default'."""
    named = prices.filter("model != 'default'")
    other = prices.filter("model = 'default'").select(F.col("price_in").alias("di"), F.col("price_out").alias("do"))
    rows = usage.join(F.broadcast(named), "model", "left").crossJoin(F.broadcast(other))  # a price list; one row
    pi, po = F.coalesce("price_in", "di"), F.coalesce("price_out", "do")
    return rows.select(*usage.columns, T.round_cost("input", "output", "cache_read", "cache_write", pi, po).alias("cost"))


def usage_totals(costs: DataFrame) -> DataFrame:
    """One row: tokens and cost of all rounds, of a table as usage_cost gives."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return costs.agg(*map(total, ("input", "output", "cache_read", "cache_write", "cost")))


def rounds_needed(docs: DataFrame, deps: DataFrame) -> DataFrame:
    """Rounds of the selected documents and those they need directly; docs(rounds), deps(round, needs)."""
    own = docs.select(F.explode("rounds").alias("round")).distinct()
    return own.unionByName(deps.join(own, "round").select(F.col("needs").alias("round"))).distinct()


def unselected(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """Documents that were not asked for."""
    return docs.join(selected.select("doc"), "doc", "left_anti")
