"""Connected components of a graph that only exists as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, c) for every end of links (a, b), both long: c is the smallest vertex that v reaches.

    Each pass points every vertex to the smallest of itself and its neighbours, follows pointers to their ends and
    contracts the links; passes end when no link is left. Links and labels stay in written tables.
    """
    links = scratch.table(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels, turn, old = None, 0, f"{name}-links"
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.table(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("c")), f"{name}-up{turn}-0")
        hop = 0
        while True:
            nxt = up.select(F.col("v").alias("c"), F.col("c").alias("d"))
            up, hop = scratch.table(up.join(nxt, "c", "left").select("v", F.coalesce("d", "c").alias("c"), (F.col("d") != F.col("c")).alias("moved")), f"{name}-up{turn}-{hop + 1}"), hop + 1
            scratch.drop(f"{name}-up{turn}-{hop - 1}")
            if up.filter("moved").isEmpty():
                break
            up = up.select("v", "c")
        up = up.select("v", "c")
        to = up.select(F.col("v").alias("c"), F.col("c").alias("d"))
        labels = up if labels is None else labels.join(to, "c", "left").select("v", F.coalesce("d", "c").alias("c"))
        labels = scratch.table(labels, f"{name}-labels{turn}")
        ends = links.join(up.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(up.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
        links = scratch.table(ends.filter("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), f"{name}-links{turn + 1}")
        for done in (old, f"{name}-up{turn}-{hop}", f"{name}-labels{turn - 1}"):
            scratch.drop(done)
        turn, old = turn + 1, f"{name}-links{turn + 1}"
    return links.select(F.col("a").alias("v"), F.col("b").alias("c")) if labels is None else labels
