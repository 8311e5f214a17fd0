"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern, the set of sources that hold them. A flow routes each pattern's words to the
quotas of its sources; a pattern offers its size once for each allowed repeat, at a cost that rises with the repeat, so
no pattern is repeated while another could serve unrepeated. Each pattern then takes its whole repeats plus, in the
order of a seeded hash, the documents that fill the rest; a document that would overshoot is passed over, and of the next
ones in that order those are taken that still fit. The number of patterns must fit the driver, that of documents need not:
the hash at which a pattern's rest is full is found from sums over runs of hashes, narrowed pass by pass.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD, Scratch, packed, unpacked



def costs_of(limit: int) -> tuple:
    """What one more word of the first, second, ... use of a pattern costs: convex, so that uses spread over patterns."""
    return tuple(k * (k + 1) // 2 for k in range(limit))


def targets(sizes: dict, weights: dict, total: int, limit: float = 3.0) -> dict:
    """Shares of total by weight; what exceeds limit times a source's size goes to the others by weight."""
    out, open_ = {}, list(sizes)
    while open_:
        left, w = total - sum(out.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > limit * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / w for s in open_}
        out |= {s: limit * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in out]
    return out


def flow(patterns: dict[tuple, int], quotas: dict, costs: tuple = costs_of(3)) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources: as much of the quotas as can be met, at least cost.

    Successive shortest paths; each path fills an arc, and paths of one cost are found by breadth first search.
    """
    names = [("in",), ("out",), *(("p", p) for p in patterns), *(("s", s) for s in quotas)]
    at = {n: i for i, n in enumerate(names)}
    head, cap, cost, of = [], [], [], [[] for _ in names]

    def arc(a, b, c, w):
        for x, y, z, u in ((a, b, c, w), (b, a, 0, -w)):
            of[x].append(len(head))
            head.append(y)
            cap.append(z)
            cost.append(u)

    for p, size in patterns.items():
        for w in costs:
            arc(0, at["p", p], size, w)
        for s in dict.fromkeys(p):
            arc(at["p", p], at["s", s], size * len(costs), 0)
    for s, q in quotas.items():
        arc(at["s", s], 1, q, 0)
    while True:
        dist, via, queue, queued = [None] * len(names), [None] * len(names), deque([0]), {0}
        dist[0] = 0
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for a in of[x]:
                if cap[a] and (dist[head[a]] is None or dist[x] + cost[a] < dist[head[a]]):
                    dist[head[a]], via[head[a]] = dist[x] + cost[a], a
                    if head[a] not in queued:
                        queue.append(head[a])
                        queued.add(head[a])
        if dist[1] is None:
            break
        path, x = [], 1
        while x:
            path.append(via[x])
            x = head[via[x] ^ 1]
        push = min(cap[a] for a in path)
        for a in path:
            cap[a] -= push
            cap[a ^ 1] += push
    out = {}
    for p in patterns:
        out[p] = {names[head[a]][1]: cap[a ^ 1] for a in of[at["p", p]] if not a & 1 and names[head[a]][0] == "s"}
    return out


def mix(
    docs: DataFrame, sources, weights: dict | tuple = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", seed: int = 17, limit: int = 3, payload: list[str] | None = None, as_row: bool = False, most_patterns: int = 100_000
) -> tuple[DataFrame, dict]:
    """One row per row of docs: id, payload, members (its sources), size (words), copies, taken (size x copies); with as_row
    the id and the payload as a struct `row`, else a payload of a result's name is left out. Second: (size, target) of each
    source.

    sources: a column, array of the sources that hold the document; null may be one of them, a document of none is never
    taken. weights: by source, or a tuple that repeats over the sources by code point, null last. A null text has size 0.
    Rows that share an id stand or fall together. Of a pattern's last repeat documents are taken in the order of a seeded
    hash until one would overshoot, then those of about the next WINDOW that still fit, in that order or large ones first, PICKS at most; or up to and with the
    one that overshoots, if that comes nearer to the quota. A pattern of no words at all stays once. Empty input gives no rows. The flow runs on the driver over at
    most most_patterns patterns; with more it raises ValueError rather than leave some out. Words are counted once.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        packed(docs, id_col, payload),
        F.coalesce(F.array_sort(F.array_distinct(sources)), F.array().cast("array<string>")).alias("members"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).bitwiseAND((1 << 63) - 1).alias("h"),
    ).withColumn("mk", F.to_json("members"))
    rows = scratch.table(rows, "rows")
    narrow = rows.select("mk", "size", "h")
    found = rows.groupBy("mk", "members").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(most_patterns + 1).collect()  # a row for each pattern
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of membership")
    sums, keys = {tuple(x["members"]): x["size"] for x in found}, {tuple(x["members"]): x["mk"] for x in found}
    sizes: dict = {}
    for p, n in sums.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    last = lambda s: (s is None, s or "")
    order = sorted(sizes, key=last)
    if not isinstance(weights, dict):
        weights = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    wanted = targets({s: sizes[s] for s in order}, weights, sum(n for p, n in sums.items() if p), limit)
    sent = flow({p: sums[p] for p in sorted(sums, key=lambda p: [last(s) for s in p])}, {s: round(t) for s, t in wanted.items()}, costs_of(limit))
    total = {p: sum(f.values()) for p, f in sent.items()}
    plan = {p: divmod(total[p], n) if n else (int(bool(p)), 0) for p, n in sums.items()}
    edge = _chosen(narrow, _thresholds(narrow, {keys[p]: r for p, (_, r) in plan.items() if r}), {x["mk"]: x["docs"] for x in found})
    listed = docs.sparkSession.createDataFrame([(keys[p], q, *edge.get(keys[p], (None, []))) for p, (q, _) in plan.items()], "mk string, q long, edge long, more array<long>")
    copies = F.col("q") + F.when((F.col("h") <= F.col("edge")) | F.array_contains("more", F.col("h")), 1).otherwise(0)
    out = rows.join(F.broadcast(listed), "mk")  # most_patterns rows at most
    return unpacked(out, ["members", "size", copies.alias("copies"), (F.col("size") * copies).alias("taken")], as_row), {s: (sizes[s], wanted[s]) for s in order}


#: Documents behind the last that fits among which others are looked for, about so many, and how many of them are taken.
WINDOW, PICKS = 512, 16


def _thresholds(narrow: DataFrame, rest: dict[str, int], bits: int = 12) -> dict[str, tuple]:
    """For each pattern two hashes up to which documents may be taken, each as (words that this misses rest by, hash, -1 for
    none): the nearest, and the last that does not overshoot. A pass sums the words of 2^bits runs of hashes and goes on in
    the run in which the rest is full."""
    at = dict.fromkeys(rest, (0, 63, 0))  # where the run begins, its length as a power of 2, words before it
    best, below = ({p: (n, -1) for p, n in rest.items()} for _ in range(2))
    while at:
        step = {p: max(0, w - bits) for p, (_, w, _) in at.items()}
        listed = narrow.sparkSession.createDataFrame([(p, lo, lo + (1 << w) - 1, step[p]) for p, (lo, w, _) in at.items()], "mk string, lo long, hi long, sh int")
        runs = narrow.join(F.broadcast(listed), "mk").filter("h between lo and hi").groupBy("mk", F.expr("shiftright(h - lo, sh)").alias("k")).agg(F.sum("size").alias("n"), F.max("h").alias("last"))
        by: dict[str, list] = {p: [] for p in at}
        for x in runs.collect():
            by[x["mk"]].append((x["k"], x["n"], x["last"]))
        for p, (lo, _, cum) in list(at.items()):
            full = None
            for k, n, last in sorted(by[p]):
                miss = rest[p] - cum - n
                best[p] = min(best[p], (abs(miss), last))
                if miss <= 0:
                    full = k
                    break
                below[p] = (miss, last)
                cum += n
            if full is None or not step[p]:
                del at[p]
            else:
                at[p] = (lo + (full << step[p]), step[p], cum)
    return {p: (best[p], below[p]) for p in rest}


def _chosen(narrow: DataFrame, ends: dict[str, tuple], docs: dict[str, int]) -> dict[str, tuple[int, list[int]]]:
    """For each pattern the hash up to which documents are taken, and the hashes of single ones behind it."""
    open_ = [(p, miss, h, min((1 << 63) - 1, h + (WINDOW << 63) // docs[p])) for p, ((near, _), (miss, h)) in ends.items() if near]
    if not open_:
        return {p: (near[1], []) for p, (near, _) in ends.items()}
    listed = F.broadcast(narrow.sparkSession.createDataFrame(open_, "mk string, miss long, lo long, hi long"))  # a row for each pattern
    next_ = narrow.join(listed, "mk").filter("h > lo and h <= hi").groupBy("mk", "miss", "h").agg(F.sum("size").alias("size")).filter("size > 0")
    begin = F.struct(F.col("miss").alias("miss"), F.array().cast("array<long>").alias("more"))
    fits = lambda a, x: (x["size"] <= a["miss"]) & (F.size(a["more"]) < PICKS)
    take = lambda a, x: F.when(fits(a, x), F.struct((a["miss"] - x["size"]).alias("miss"), F.concat(a["more"], F.array(x["id"])).alias("more"))).otherwise(a)
    fold = lambda *order: F.aggregate(F.array_sort(F.collect_list(F.struct(*order, F.col("size"), F.col("h").alias("id")))), F.first(begin), take)
    folds = next_.groupBy("mk").agg(F.array_min(F.array(fold("h"), fold((-F.col("size")).alias("large")))).alias("f"))  # in order, or large ones first
    found = {x["mk"]: (x["f"]["miss"], x["f"]["more"]) for x in folds.collect()}
    return {p: (below[1], found[p][1]) if p in found and found[p][0] < near[0] else (near[1], []) for p, (near, below) in ends.items()}
