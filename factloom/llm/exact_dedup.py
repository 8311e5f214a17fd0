"""Exact dedup by distributed MSD radix partitioning.

A document's string is the length of its normalised text, then its bytes. Documents are split by the length and the
first digit of `first` bytes; groups of one leave; the others are split again by their next digit, each `growth` times as
long as the one before, until the text has ended. Members of an ended group agree in every byte; no digest is compared.
A level moves only what has not left: its digits are counted with map-side sums, and the counts are joined back, which
Spark's skew join splits for a group of any size. These joins are merge joins at every size, as the counts grow with the
documents: a small table takes no way that a large one could not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, Scratch, packed, unpacked


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None, first: int = 32, growth: int = 16, as_row: bool = False) -> DataFrame:
    """One row per row of docs: id, the payload columns, keep_id, group_size, kept, text_sha256; with as_row the id and the
    payload as a struct `row`, else a payload of a result's name is left out.

    Null text counts as empty. Of a group, the row with most code points in its own text stays, then the smallest id
    (null last); of rows that also share the id exactly one stays. Empty input gives no rows. Columns of docs that are
    not asked for are ignored, whatever their names. A text is normalised as it is
    read, and once more if it is still in question after the first digit; later levels move the normalised bytes.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text, own = F.col(f"`{text_col}`"), text_col in (payload or [])  # a text that is carried anyway is not carried twice
    rows = docs.select(packed(docs, id_col, payload), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n_cp"), F.lit(None).cast("string").alias("t") if own else text.cast("string").alias("t"), normalised(text).cast("binary").alias("b"))
    rows = rows.select("row", "id", "n_cp", "t", F.monotonically_increasing_id().alias("uid"), F.octet_length("b").alias("len"), F.substring("b", 1, first).alias("dig"), F.sha2("b", 256).alias("sha"))
    rows = scratch.table(rows, "rows")
    narrow = rows.select("uid", "id", "n_cp")
    start = rows.select("uid", "len", "dig", (F.col(f"row.`{text_col}`") if own else F.col("t")).alias("t"))
    groups = _groups(start, ["len", "dig"], scratch, "g0")
    joined = start.join(groups.hint("merge"), ["len", "dig"]).withColumn("t", F.when(F.col("len") > first, normalised(F.col("t"))).cast("binary"))
    level, digit, done, ended = 0, first, first, []
    while True:
        whole = F.col("len") <= done
        out = scratch.table(joined.select("uid", "len", "gid", F.when(~whole, F.col("t")).alias("t")), f"level{level}")
        if level:
            scratch.drop(f"g{level}")
        ended.append(out.filter(whole).select("uid", "gid"))
        active = out.filter(~whole)
        if active.isEmpty():
            break
        level, digit = level + 1, digit * growth
        cut = active.withColumnRenamed("gid", "was").withColumn("dig", F.substring("t", done + 1, digit))
        joined = cut.join(_groups(cut, ["was", "dig"], scratch, f"g{level}").hint("merge"), ["was", "dig"])
        joined = joined.withColumn("gid", F.col("gid") + F.lit(level) * F.lit(1 << 58))
        done += digit
    same = ended[0]
    for f in ended[1:]:
        same = same.unionByName(f)
    copies = same.join(narrow.hint("merge"), "uid")
    best = copies.groupBy("gid").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_cp")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("keep_id"), F.col("uid").alias("u"))).alias("b"))
    best = scratch.table(best.select("gid", "group_size", "b.keep_id", "b.u"), "best")  # written, so that the join below can split a group of any size
    known = same.join(best.hint("merge"), "gid").select("uid", "keep_id", "group_size", (F.col("uid") == F.col("u")).alias("k"))
    out = rows.select("uid", "row", "id", "sha").join(known.hint("merge"), "uid", "left")
    alone = F.col("k").isNull()
    results = [F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("k", F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256")]
    return unpacked(out, results, as_row)


def _groups(rows: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The keys that more than one row has, each with an id; written, so that the ids hold."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1")
    return scratch.table(counts.select(*key, F.monotonically_increasing_id().alias("gid")), name)
