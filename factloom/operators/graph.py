"""Import resolution and file and module graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.written import Work

#: What is tried after a specifier, in this order.
SUFFIXES = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


#: Endings of compiled code, which are also tried without.
COMPILED = ("js", "jsx", "mjs", "cjs")


def resolve(imports: DataFrame, known: DataFrame, suffixes: tuple = SUFFIXES, parts: int | None = None) -> DataFrame:
    """imports(src, specifier) with the known path that the first matching candidate names; others leave.

    Each known path tells the few bases from which a candidate leads to it, with the candidate's rank, and imports meet
    these by their base in one equi-join; the smallest rank wins. A base that ends like compiled code is tried as written,
    then without its extension. parts: tasks in which the smallest ranks are found, to be named by callers
    whose imports are many, since adaptive execution joins partitions by their bytes when packed.
    """
    base = F.explode(F.array(T.resolve_path("src", "specifier")))  # a generator, so that it is computed once and not for each use
    rows = imports.select("src", "specifier", base.alias("base")).filter("base is not null")
    path, n = F.col("path"), len(suffixes)
    cut = lambda s: F.substring(path, F.lit(1), F.length(path) - len(s))
    pair = lambda b, rank: F.struct(b.alias("base"), F.lit(rank).alias("rank"))
    ways = []
    for i, s in enumerate(suffixes):
        ends = F.endswith(path, F.lit(s)) & (F.length(path) > len(s))
        ways.append(F.when(ends, F.array(pair(cut(s), i), *(pair(F.concat(cut(s), F.lit("." + e)), n + i) for e in COMPILED))))
    leads = known.select("path").distinct().select("path", F.explode(F.flatten(F.filter(F.array(*ways), lambda w: w.isNotNull()))).alias("w")).select("path", "w.base", "w.rank")
    met = rows.join(leads, "base")
    return (met.repartition(parts, "src", "specifier") if parts else met).groupBy("src", "specifier").agg(F.min_by("path", "rank").alias("dst"))


def file_graph(resolved: DataFrame) -> DataFrame:
    """Distinct links between different files."""
    return resolved.filter("src != dst").select("src", "dst").distinct()


def importers(resolved: DataFrame) -> DataFrame:
    """Importers per file; a file that imports itself counts."""
    return resolved.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("importers"))


def lift(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Links between the groups of the ends; member(node, grp, seq): the last group of a node wins."""
    of = member.groupBy("node").agg(F.max_by("grp", "seq").alias("grp"))
    a, b = of.select(F.col("node").alias("src"), F.col("grp").alias("a")), of.select(F.col("node").alias("dst"), F.col("grp").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a != b").select("a", "b").distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches; edges(a, b)."""
    return nodes.join(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti")


def connected(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """claims(a, b) with `held`: whether an edge joins them in either direction."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("held", F.lit(True))
    return claims.join(both, ["a", "b"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (a, b) where b is reached from a, for graphs whose pairs are the question; `reach` follows from given nodes only.
    Each round joins the pairs that the last one found with pairs of the same length, so lengths double and 64 rounds are
    beyond any graph. RuntimeError if they are not enough, rather than an incomplete answer."""
    work = Work(edges.sparkSession, "closure")
    known = fresh = work.table(edges.select("a", "b").distinct(), "pairs0")
    for turn in range(1, rounds + 1):
        longer = known.alias("x").join(fresh.alias("y"), F.expr("x.b = y.a")).select("x.a", "y.b").unionByName(fresh.alias("x").join(known.alias("y"), F.expr("x.b = y.a")).select("x.a", "y.b"))
        fresh = work.table(longer.distinct().join(known, ["a", "b"], "left_anti"), f"fresh{turn}")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError(f"paths still grew after {rounds} rounds")


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops) of what is reached from start(node) along edges(a, b), the start itself with 0 hops.

    Semi-naive: a round follows the edges of the nodes that the last one found and keeps what is new, so work is in the edges
    that are reached, and rounds are the longest way. Cycles end it like any other way.
    """
    work = Work(edges.sparkSession, "reach")
    links = work.table(edges.select("a", F.col("b").alias("node")).distinct(), "edges")
    fresh = known = work.table(start.select("node", F.lit(0).alias("hops")).filter("node is not null").distinct(), "found0")
    turn = 0
    while not fresh.isEmpty():
        turn += 1
        found = links.join(fresh.select(F.col("node").alias("a")), "a").select("node").filter("node is not null").distinct()
        fresh = work.table(found.join(known.select("node"), "node", "left_anti").withColumn("hops", F.lit(turn)), f"found{turn}")
        known = known.unionByName(fresh)
    return known


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of each of nodes(node) by the longest way from a node that needs none; null for nodes on a cycle or
    behind one. edges(a, b): b needs a; edges with an end that is no node count as met (they are `unknown_needs`).

    Peeling: a layer's nodes leave together and tell the nodes behind them, whose number of open needs falls; only nodes that
    were told are looked at. Rounds are the longest way.
    """
    work = Work(nodes.sparkSession, "layers")
    known = nodes.select("node").filter("node is not null").distinct()
    links = edges.select("a", "b").distinct().join(known.select(F.col("node").alias("a")), "a", "left_semi").join(known.select(F.col("node").alias("b")), "b", "left_semi")
    links = work.table(links, "edges")
    needs = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("open"))
    needs = work.table(needs, "needs")
    fresh = work.table(known.join(needs, "node", "left_anti").withColumn("layer", F.lit(0)), "layer0")
    met, done, turn = None, fresh, 0
    while not fresh.isEmpty():
        turn += 1
        told = links.join(fresh.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("met"))
        told = told if met is None else told.join(met.withColumnRenamed("met", "before"), "node", "left").select("node", (F.col("met") + F.coalesce("before", F.lit(0))).alias("met"))
        told = work.table(told.join(needs, "node").select("node", "met", "open"), f"told{turn}")
        fresh = work.table(told.filter("met = open").select("node", F.lit(turn).alias("layer")), f"layer{turn}")
        still = told.filter("met < open").select("node", "met")
        met = still if met is None else work.table(met.join(told.select("node"), "node", "left_anti").unionByName(still), f"met{turn}")
        done = done.unionByName(fresh)
    return known.join(done, "node", "left")


def unknown_needs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: edges(a, b) whose node b needs one that is not there."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_anti")


def validate_steps(steps: list[tuple[str, list[str]]]) -> dict:
    """G1: names that are unknown or given twice and, if there are none, those on or behind a cycle."""
    names = [s for s, _ in steps]
    twice = sorted({n for n in names if names.count(n) > 1})
    unknown = sorted({d for _, deps in steps for d in deps if d not in names})
    left = {s: set(deps) for s, deps in steps}
    while not (twice or unknown) and (free := [s for s, d in left.items() if not d & left.keys()]):
        for s in free:
            del left[s]
    return {"duplicate": twice, "unknown": unknown, "cycle": [] if twice or unknown else sorted(left)}
