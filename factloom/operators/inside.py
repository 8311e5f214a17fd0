"""Which texts hold which names, by an inverted index of character grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.written import Work


def _chars(text: str):
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _grams(chars: str, size) -> F.Column:
    """Distinct runs of so many characters."""
    each = F.transform(F.sequence(F.lit(1), F.size(chars) - size + 1), lambda i: F.array_join(F.slice(chars, i, size), ""))
    return F.when(F.size(chars) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def holders(names: DataFrame, texts: DataFrame, q: int = 3) -> DataFrame:
    """(name, text): every text of texts(text) that holds a name of names(name), each pair once.

    A name is looked for under the one of its grams that fewest texts have, of q characters or of its own length if it is
    shorter; what is found there is compared whole. A name that no text can hold, because one of its grams is in none, is given
    up before that. Null and empty names and null texts take no part.
    """
    work = Work(names.sparkSession, "inside")
    n = names.select("name").filter("name != ''").distinct().withColumn("chars", _chars("name"))
    n = work.table(n.select("name", F.explode(_grams("chars", F.least(F.lit(q), F.size("chars")))).alias("gram")), "names")
    wanted = n.select("gram").distinct()
    t = texts.select("text").filter("text is not null").distinct().withColumn("chars", _chars("text"))
    every = F.concat(*(_grams("chars", F.lit(size)) for size in range(1, q + 1)))
    t = work.table(t.select("text", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi"), "texts")
    often = t.groupBy("gram").agg(F.count("*").alias("often"))
    rarest = n.join(often, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("g")).filter("g.often > 0")
    return t.join(rarest.select("name", F.col("g.gram").alias("gram")), "gram").filter(F.contains("text", F.col("name"))).select("name", "text")
