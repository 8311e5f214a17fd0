"""Names within an edit distance, by a positional q-gram prefix filter.

An edit of one code point destroys at most q of a name's q-grams, an exchange of two neighbours at most q + 1, and so k edits
of any kind leave all but k(q + 1). Sorted by rising frequency over both sides, the first k(q + 1) + 1 grams of two names
within k therefore share one, at places that differ by what k edits can shift, in names whose lengths differ by k at most:
prefixes meet in an inverted index by equality of gram, place and length. Pairs that met must agree in all but k distinct code
points either way, then in all but k(q + 1) grams; what is left is measured.

Longer names take longer grams. Names too short for bigrams meet in length buckets that are split by code points, of which an
exchange destroys none; names of k code points at most may share nothing and meet by length alone.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, Scratch

LONGEST = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(name):
    """A-Z in lower case, without ASCII white space."""
    return F.translate(F.regexp_replace(name, SPACE, ""), UPPER, LOWER)


def gram_length(length, k: int):
    """q of a name of this length: the longest of 2 to LONGEST that leaves one gram beyond the prefix; 1 for shorter names,
    0 where k edits may replace the whole name."""
    q = F.when(length <= k, 0)
    for n in range(LONGEST, 1, -1):
        q = q.when(length - n + 1 > k * (n + 1) + (n > 2), n)
    return q.otherwise(1)


def moves(k: int):
    """(difference of lengths, shift of a surviving gram) that k insertions and deletions can cause."""
    for dl in range(-k, k + 1):
        spare = (k - abs(dl)) // 2
        for shift in range(-spare + min(0, dl), spare + max(0, dl) + 1):
            yield dl, shift


def distance(x: str, y: str, k: int) -> int | None:
    """Unrestricted Damerau-Levenshtein distance of two strings if it is at most k."""
    a, m = 0, min(len(x), len(y))
    while a < m and x[a] == y[a]:
        a += 1
    b = 0
    while b < m - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if abs(len(x) - len(y)) > k:
        return None
    if not x or not y:
        return len(x) + len(y)
    if k == 0:
        return None
    ways = [(1, x[1:], y[1:]), (1, x[1:], y), (1, x, y[1:])]
    for i in range(1, min(k + 1, len(x))):  # the first of x and its i-th change places; what lay between them goes, what lies between them in y comes
        ways += [(i + j - 1, x[i + 1 :], y[j + 1 :]) for j in range(1, min(k + 2 - i, len(y))) if x[0] == y[j] and x[i] == y[0]]
    best = None
    for cost, u, v in ways:
        rest = distance(u, v, (k if best is None else best - 1) - cost) if cost <= (k if best is None else best - 1) else None
        if rest is not None:
            best = cost + rest
    return best


def shared_enough(x: str, y: str, q: int, k: int) -> bool:
    """The count filter: of q-grams of the longer name at most k(q + 1) are missing in the other."""
    if q < 2:
        return True
    u, v = (Counter(s[i : i + q] for i in range(len(s) - q + 1)) for s in (x, y))
    return (u & v).total() >= max(len(x), len(y)) - q + 1 - k * (q + 1)


def _listed(names: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """nid, name, len and a bit for each code point that occurs, by hash; names written once keep their numbers."""
    rows = names.select(F.col(names.columns[0]).cast("string").alias("name")).filter("name != ''").distinct()
    rows = scratch.table(rows.withColumn("nid", F.monotonically_increasing_id()), name)
    bits = "aggregate(regexp_extract_all(name, '(?s).', 0), 0L, (a, c) -> a | shiftleft(1L, cast(pmod(xxhash64(c), 64) as int)))"
    return rows.select("nid", "name", F.length("name").alias("len"), F.expr(bits).alias("bits"))


def _grams(rows: DataFrame, k: int, partners: bool) -> DataFrame:
    """nid, len, bits, q, gram, pos: every positional gram of each name; with partners for each q that a name of a length within
    k uses. Grams of q = 1 are distinct code points, those of q = 0 empty, both without a place."""
    lengths = F.sequence(F.greatest(F.col("len") - k, F.lit(1)), F.col("len") + k) if partners else F.array("len")
    rows = rows.select("nid", "len", "bits", F.regexp_extract_all("name", F.lit("(?s)."), F.lit(0)).alias("chars"), F.explode(F.array_distinct(F.transform(lengths, lambda n: gram_length(n, k)))).alias("q"))
    whole = "transform(sequence(1, len - q + 1), i -> struct(array_join(slice(chars, i, q), '') as gram, i as pos))"
    grams = F.expr(f"CASE WHEN q = 0 THEN array(struct('' as gram, 0 as pos)) WHEN q = 1 THEN transform(array_distinct(chars), c -> struct(c as gram, 0 as pos)) WHEN len >= q THEN {whole} END")
    return rows.select("nid", "len", "bits", "q", F.explode(grams).alias("g")).select("nid", "len", "bits", "q", "g.gram", "g.pos")


def _prefixes(grams: DataFrame, often: DataFrame, k: int) -> DataFrame:
    """The first grams of each name, globally rare ones first; as many as k edits can destroy, and one more."""
    known = grams.join(often.hint("merge"), ["q", "gram"])
    per = known.groupBy("nid", "len", "bits", "q").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "pos"))).alias("all"))
    first = F.when(F.col("q") > 1, k * (F.col("q") + 1) + 1).otherwise(k + 1)
    return per.select("nid", "len", "bits", "q", F.explode(F.slice("all", F.lit(1), first)).alias("g")).select("nid", "len", "bits", "q", "g.gram", "g.pos")


def join_names(left: DataFrame, right: DataFrame, k: int = 1) -> DataFrame:
    """(left_name, right_name, distance): every pair of distinct names of the first column of left and of right whose
    unrestricted Damerau-Levenshtein distance over code points is at most k, once.

    Names are compared as they are. Null and empty names take no part; names that repeat count once, so that their rows are the
    caller's to join back; tables without names give no pairs. A name of any length costs as many rows as it has code points.
    Nothing that grows with the names is collected or broadcast: all joins are merge joins, which adaptive execution can split
    where many names share a gram.
    """
    scratch = Scratch(left.sparkSession, "names")
    a, b = _listed(left, scratch, "left"), _listed(right, scratch, "right")
    ga, gb = scratch.table(_grams(a, k, False), "grams-left"), scratch.table(_grams(b, k, True), "grams-right")
    often = scratch.table(ga.select("q", "gram").unionByName(gb.select("q", "gram")).groupBy("q", "gram").agg(F.count("*").alias("often")), "often")
    step = lambda pairs: F.array(*(F.struct(F.lit(dl).alias("dl"), F.lit(s).alias("shift")) for dl, s in pairs))
    shifts = F.when(F.col("q") > 1, step(moves(k))).otherwise(step((dl, 0) for dl in range(-k, k + 1)))
    probes = _prefixes(ga, often, k).withColumn("m", F.explode(shifts)).select(F.col("nid").alias("a"), F.col("bits").alias("abits"), "q", "gram", (F.col("pos") + F.col("m.shift")).alias("pos"), (F.col("len") + F.col("m.dl")).alias("len"))
    index = _prefixes(gb, often, k).select(F.col("nid").alias("b"), F.col("bits").alias("bbits"), "q", "gram", "pos", "len")
    unlike = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    met = probes.alias("p").join(index.alias("i").hint("merge"), [F.col(f"p.{c}") == F.col(f"i.{c}") for c in ("gram", "pos", "len", "q")] + [unlike("abits", "bbits") <= k, unlike("bbits", "abits") <= k])
    met = scratch.table(met.select("a", "b", "p.q").distinct(), "met")
    named = met.join(a.select(F.col("nid").alias("a"), F.col("name").alias("left_name")).hint("merge"), "a").join(b.select(F.col("nid").alias("b"), F.col("name").alias("right_name")).hint("merge"), "b")

    def measure(batches):
        for batch in batches:
            out = []
            for q, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = distance(x, y, k) if shared_enough(x, y, q, k) else None
                if d is not None:
                    out.append((x, y, d))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["left_name", "right_name", "distance"])

    return scratch.table(named.select("q", "left_name", "right_name").mapInArrow(measure, "left_name string, right_name string, distance int"), "pairs")
