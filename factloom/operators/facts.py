"""Aggregates over files, commits, references and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def by_extension(files: DataFrame) -> DataFrame:
    """Files per extension and their percentage; files(path or extension)."""
    n = files.groupBy(F.coalesce(F.nullif("extension", F.lit("")), F.lit("(no extension)")).alias("extension")).agg(F.count("*").alias("files"))
    return n.withColumn("percent", F.round(100 * F.col("files") / F.sum("files").over(Window.partitionBy(F.lit(1))), 4))


def ancestors(paths: DataFrame) -> DataFrame:
    """Every folder above a path and the number of files directly in it."""
    p = paths.select(F.split("path", "/").alias("p")).filter(F.size("p") > 1)
    up = p.select(F.explode(F.expr("transform(sequence(1, size(p) - 1), i -> array_join(slice(p, 1, i), '/'))")).alias("dir"), F.expr("array_join(slice(p, 1, size(p) - 1), '/')").alias("own"))
    return up.groupBy("dir").agg(F.count_if(F.col("dir") == F.col("own")).alias("children"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n by a total order; the last of the order must be unique."""
    return df.orderBy(*order).limit(n)


def per_group(df: DataFrame, n: int, by: list[str], *order) -> DataFrame:
    """The first n of each group; Spark keeps n rows of a group on each side of the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def owners(changes: DataFrame) -> DataFrame:
    """A10: for each path the author of most changes; of equals the one seen first, of those seen
    together the last by name. changes(path, author, seq)."""
    n = changes.groupBy("path", "author").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return n.groupBy("path").agg(F.max_by("author", F.struct("n", (-F.col("first")).alias("f"), "author")).alias("owner"), F.max("n").alias("changes"))


def contributors(commits: DataFrame) -> DataFrame:
    """Commits of each name and e-mail; commits(name, email)."""
    return commits.groupBy("name", "email").agg(F.count("*").alias("commits"))


def recent(commits: DataFrame, n: int = 100) -> DataFrame:
    """The first n commits in the order of the log; commits(seq)."""
    return commits.orderBy("seq").limit(n)


def months(commits: DataFrame) -> DataFrame:
    """Commits of each month, the latest first."""
    return by_month(commits).orderBy(F.desc("month"))


def remark_counts(todos: DataFrame) -> DataFrame:
    """Remarks of each file."""
    return todos.groupBy("path").agg(F.count("*").alias("todos"))


def by_month(commits: DataFrame) -> DataFrame:
    """By the first seven characters of the date, in the author's own offset."""
    return commits.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("commits"))


def lines(files: DataFrame, key: str = "path") -> DataFrame:
    """Lines of files, from 1."""
    return files.select(key, F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def todos(files: DataFrame) -> DataFrame:
    """One row per line with a marker."""
    found = lines(files).withColumn("marker", T.todo_marker("text")).filter("marker is not null")
    return found.select("path", "line", "marker", T.todo_category("marker").alias("category"), T.todo_text("text").alias("text"), T.issue_refs("text").alias("issue_refs"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Rows and percentage per value."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(by, "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"))  # one row


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Paths whose hash is new or differs; deleted ones are not reported. Both (path, hash)."""
    old = before.select("path", F.col("hash").alias("old"))
    return now.join(old, "path", "left").filter("not (old <=> hash)").select("path", F.when(F.col("old").isNull(), "new").otherwise("modified").alias("status"))


def branch_age(branches: DataFrame, now) -> DataFrame:
    """P20: up to 30 days active, from 90 stale, neither between."""
    days = F.datediff(now, "commit_ts")
    return branches.withColumn("age", F.when(days <= 30, "active").when(days >= 90, "stale").otherwise("between"))


def branch_strategy(branches: DataFrame) -> DataFrame:
    """One row."""
    some = lambda p: F.coalesce(F.bool_or(F.rlike("name", F.lit(p))), F.lit(False))
    return branches.agg(some(r"(?:^|/)(?:develop|dev)$").alias("d"), some(r"release[/-]").alias("r"), some(r"feature[/-]").alias("f"), F.count("*").alias("n")).select(
        F.when(F.col("d") & F.col("r"), "git-flow").when(F.col("f") & ~F.col("d"), "feature-branch").when(F.col("n") <= 3, "trunk-based").otherwise("unknown").alias("strategy")
    )
