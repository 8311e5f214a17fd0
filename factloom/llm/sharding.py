"""Minimax contiguous partition of documents into shards of near equal bytes.

Documents with equal texts are one atomic group, groups are ordered by their smallest doc_id, and shards are runs of
groups. The smallest feasible shard capacity is found by binary search with a greedy check, and the cuts are set under it.
The sizes of all groups never come to the driver: it holds a bounded number of points of their running sum and asks for
finer points only where a cut may lie, until greedy checks on what is known and on what is possible agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, running


class Points:
    """Known points of the running sum: ends[i], with rows[i] documents up to it; whole[i] says that no group ends
    between ends[i-1] and ends[i]. ends[0] is 0."""

    def __init__(self, ends, rows, whole):
        self.ends, self.rows, self.whole = ends, rows, whole

    def greedy(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Where each shard ends at worst and at best, filled up to capacity from left to right."""
        worst, best, low, high = 0, 0, [], []
        for _ in range(shards):
            i = int(np.searchsorted(self.ends, worst + capacity, "right")) - 1
            worst = int(self.ends[i])
            v = min(best + capacity, int(self.ends[-1]))
            j = int(np.searchsorted(self.ends, v, "right")) - 1
            best = v if j + 1 < len(self.ends) and not self.whole[j + 1] else int(self.ends[j])
            low.append(worst)
            high.append(best)
        return low, high

    def bounds(self, shards: int) -> tuple[int, int]:
        """The smallest capacities that may do and that surely do."""
        total = int(self.ends[-1])

        def least(k):
            a, b = 0, total
            while a < b:
                m = (a + b) // 2
                if self.greedy(m, shards)[k][-1] >= total:
                    b = m
                else:
                    a = m + 1
            return a

        return least(1), least(0)


def cuts(groups: DataFrame, total: int, shards: int, points: int = 20_000) -> tuple[int, Points, list[int]]:
    """Smallest capacity, the points known in the end, and the shards' ends; groups has `e` and `r`, the running sums of
    bytes and rows."""

    def fetch(ranges, width):
        """For each run of `width` in each range: its smallest and largest e, the latter with its r."""
        inside, which = F.lit(False), F.lit(len(ranges))
        for i, (a, b) in reversed(list(enumerate(ranges))):
            inside, which = inside | ((F.col("e") > a) & (F.col("e") <= b)), F.when(F.col("e") <= b, i).otherwise(which)
        got = groups.filter(inside).groupBy(which.alias("i"), F.expr(f"(e - 1) div {width}").alias("k")).agg(F.min("e").alias("a"), F.max(F.struct("e", "r")).alias("b"))
        return sorted((x["a"], x["b"]["e"], x["b"]["r"]) for x in got.collect())

    width = max(1, -(-total // points))
    got = fetch([(0, total)], width)
    known = Points(np.array([0, *(x[1] for x in got)]), np.array([0, *(x[2] for x in got)]), np.array([True, *(x[0] == x[1] for x in got)]))
    while True:
        low, high = known.bounds(shards)
        if low == high:
            return high, known, _level(known, high, shards)
        first, last = known.greedy(low, shards)[0], known.greedy(high, shards)[1]
        ranges: list[list[int]] = []
        for a, b in zip(first, last, strict=True):
            i = max(0, int(np.searchsorted(known.ends, a, "right")) - 1)
            j = min(len(known.ends) - 1, int(np.searchsorted(known.ends, b, "right")))
            a, b = int(known.ends[i]), int(known.ends[j])
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = max(b, ranges[-1][1])
            elif a < b:
                ranges.append([a, b])
        width = max(1, min(width // 4, sum(b - a for a, b in ranges) // points))
        got = fetch(ranges, width)
        new = {int(e): (int(r), bool(w)) for e, r, w in zip(known.ends, known.rows, known.whole, strict=True)}
        for a, b in ranges:
            for e in [e for e in new if a < e <= b]:
                del new[e]
        for a, e, r in got:
            new[e] = (r, a == e)
        order = sorted(new)
        known = Points(np.array(order), np.array([new[e][0] for e in order]), np.array([new[e][1] for e in order]))


def _level(known: Points, capacity: int, shards: int) -> list[int]:
    """Ends of the shards: each takes an even share of what is left, as far as the capacity and the later shards allow."""
    total = int(known.ends[-1])
    latest = [total]  # how little may be placed by shard k, so that the rest fits
    for _ in range(shards - 1):
        i = int(np.searchsorted(known.ends, latest[-1] - capacity, "left"))
        latest.append(int(known.ends[min(i, len(known.ends) - 1)]))
    least, at, out = latest[::-1], 0, []
    for k in range(shards):
        want = at + (total - at) / (shards - k)
        i = int(np.searchsorted(known.ends, want))
        near = min((int(known.ends[x]) for x in (i - 1, i) if 0 <= x < len(known.ends)), key=lambda e: abs(e - want))
        top = int(known.ends[int(np.searchsorted(known.ends, at + capacity, "right")) - 1])
        at = max(at, min(max(near, least[k]), top))
        out.append(at)
    return out if out[-1] == total else known.greedy(capacity, shards)[0]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size: UTF-8 bytes plus 8. Null texts count no bytes, have the crc32 of no bytes, and form one group. Order: groups by
    smallest doc_id, then digest; rows of a group by doc_id (null first). Repeated rows take slots of their own. With
    fewer groups than shards some shards are empty. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("key")
    )
    rows = scratch.table(rows, "rows")
    sums = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"), F.count("*").alias("rows"))
    sums = scratch.table(sums, "sums")  # written, so that the join below can split a group of any size
    groups, parts = running(sums.select("first", "key", "size", "rows"), ["first", "key"], {"e": "size", "r": "rows"}, scratch, "groups")
    total = sum(p["e"] for p in parts)
    before, offsets = [0, 0], []
    for p in parts:
        offsets.append((p["part"], *before))
        before = [before[0] + p["e"], before[1] + p["r"]]
    ends = [0] * shards
    if total:
        at = docs.sparkSession.createDataFrame(offsets, "part int, oe long, ro long")  # a row for each partition
        placed = scratch.table(groups.join(F.broadcast(at), "part").select((F.col("e") + F.col("oe")).alias("e"), (F.col("r") + F.col("ro")).alias("r")), "prefix")
        _, known, cut = cuts(placed, total, shards)
        rows_at = dict(zip(known.ends.tolist(), known.rows.tolist(), strict=True))
        ends = [rows_at[e] for e in cut]
    first = sums.select("key", "first")
    whole = rows.join(first.hint("merge"), "key").select("first", "key", "doc_id", "size", "text_crc32", F.lit(1).alias("one"))
    order = ["first", "key", "doc_id", "size"]
    whole, parts = running(whole, order, {"n": "one"}, scratch, "placed")
    offsets, seen = [], 0
    for p in parts:
        offsets.append((p["part"], seen))
        seen += p["n"]
    at = docs.sparkSession.createDataFrame(offsets, "part int, o long")
    index = F.col("n") + F.col("o") - 1
    number = sum((F.when(index >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    starts = F.array(*(F.lit(e).cast("long") for e in [0, *ends[:-1]]))
    return (
        whole.join(F.broadcast(at), "part").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), number.cast("int").alias("shard"), index.alias("i"))
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("i") - F.element_at(starts, F.col("shard") + 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
