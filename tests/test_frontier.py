"""Graphs by frontier, globs and names by index, and payloads, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from factloom.operators import graph, incremental, inside
from factloom.sources import payloads


def test_layers_and_reach(spark):
    r = random.Random(8)
    for turn in range(4):
        nodes = list(range(30))
        edges = [(r.randrange(32), r.randrange(30)) for _ in range(25 + 12 * turn)]
        edges = [(a, b) for a, b in edges if a < b or turn > 1]
        frame = spark.createDataFrame(edges + edges[:3], "a long, b long")
        want, left = {}, {b: {a for a, x in edges if x == b and a in nodes} for b in nodes}
        layer = 0
        while free := [n for n in left if not left[n]]:
            for n in free:
                want[n] = layer
                del left[n]
            for n in left:
                left[n] -= set(free)
            layer += 1
        got = {x.node: x.layer for x in graph.layers(spark.createDataFrame([(n,) for n in nodes], "node long"), frame).collect()}
        assert got == {n: want.get(n) for n in nodes}
        assert {(x.a, x.b) for x in graph.unknown_needs(spark.createDataFrame([(n,) for n in nodes], "node long"), frame).collect()} == {e for e in edges if e[0] > 29}
        hops, at = {3: 0, 5: 0}, 0
        while new := {b for a, b in edges if hops.get(a) == at and b not in hops}:
            at += 1
            hops |= dict.fromkeys(new, at)
        assert {x.node: x.hops for x in graph.reach(frame, spark.createDataFrame([(3,), (5,), (5,), (None,)], "node long")).collect()} == hops
    none = spark.createDataFrame([], "node long")
    assert graph.layers(none, frame).count() == graph.reach(frame, none).count() == 0
    pairs = {(x.a, x.b) for x in graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")).collect()}
    assert pairs == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}


def test_globs(spark):
    paths = ["a.ts", "src/a.ts", "src/b/c.ts", "src/b/c.tsx", "src/b/.env", "docs/x.md", "src/a[1].ts", "deep/er/src/a.ts", "Dockerfile", "x/Dockerfile", None]
    globs = ["**", "**/*", "*.ts", "src/**/*.ts", "src/*", "src/b/c.ts", "**/Dockerfile", "src/?.ts", "**/b/*.ts?", "src/a[1].ts", "docs/*.m*", "", "none/**", None, "src/**"]
    listed = spark.createDataFrame([(f"r{i}", g) for i, g in enumerate(globs)] + [("r0", "**")], "name string, glob string")
    found = incremental.match_globs(listed, spark.createDataFrame([(p,) for p in paths] * 2, "path string"))
    got = {(x.name, x.path) for x in found.collect()}
    assert got == {(f"r{i}", p) for i, g in enumerate(globs) for p in paths if g is not None and p and re.match(incremental.glob_regex(g), p)}
    assert found.count() == len(got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 4  # each side once, whatever the number of globs


def test_names_inside(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcé😀/") for _ in range(n))
    names = [word(r.randint(0, 5)) for _ in range(80)] + [None, "zzz"]
    texts = [word(r.randint(0, 30)) for _ in range(60)] + [None, "", "z" * 5000]
    got = inside.holders(spark.createDataFrame([(n,) for n in names * 2], "name string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = {(n, t) for n in names for t in texts if n and t and n in t}
    assert sorted(map(tuple, got)) == sorted(want)
    assert ("zzz", "z" * 5000) in want


def test_payloads(spark):
    rows = ['{"k": 1, "d": {"v": "x"}, "more": [1]}', '{"k": "7"}', '{"k": "x"}', '{"k": null}', "{}", "[1]", '"k"', "{", "", None, '{"k": 2, "d": "flat"}', '{"k": 3, "d": {"v": null}}']
    read = payloads.read(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p string"), "p", {"k": "$.k as int"}, {"v": "$.d.v as string"})
    good, refused = payloads.sides(read)
    assert {x.i: tuple(x.fields) for x in good.collect()} == {0: (1, "x"), 1: (7, None), 10: (2, None), 11: (3, None)}
    assert {x.i: x.refused for x in refused.collect()} == {2: "k is no int", 3: "k is missing", 4: "k is missing", 5: "no object", 6: "no object", 7: "no JSON", 8: "no JSON", 9: "no payload"}
    whole = payloads.schema(read.filter(F.col("i") < 2)).first()
    assert "more: ARRAY" in whole.schema
    assert (whole.payloads, whole.refused) == (2, 0)
    assert payloads.read(spark.createDataFrame([], "p string"), "p", {"k": "$.k as int"}).count() == 0


def test_tenths_round_as_doubles_do(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from factloom.functions import text as T

    for unit in (1000, 1_000_000):
        rows = [(n * unit // 1000 + d,) for n in range(1000, 9000, 50) for d in (-1, 0, 1)]
        got = spark.createDataFrame(rows, "n long").select("n", T.tenths("n", unit).alias("t")).collect()
        assert {x.n: x.t for x in got} == {n: str(Decimal(n / unit).quantize(Decimal("0.1"), ROUND_HALF_UP)) for (n,) in rows}


def test_globs_are_found_by_fixed_names_and_joined_in_tiles(spark, monkeypatch):
    key = incremental.glob_key
    assert (key("**/index.html"), key("src/a.ts"), key("src/*.html"), key("a/**/b/c.ts"), key("x**/y"), key("**/")) == (("", "/index.html"), ("src", "/a.ts"), ("src", "html"), ("a", "/c.ts"), ("", "y"), ("", "/"))
    monkeypatch.setattr(incremental, "ROWS", 3)
    paths = ["a.ts", "src/a.ts", "src/x/a.ts", "src/ba.ts", "xy", "x/y", "xa/y", "src/", "", "src/x/", "y", "b/c.ts", "a/b/c.ts", "a/q/b/c.ts"]
    globs = ["**/a.ts", "src/a.ts", "src/*", "src/**", "x**/y", "x*/y", "**/", "*.ts", "a/**/b/c.ts", "a/**/c.ts", "***/y", "?**/y", "/**/a.ts", "a.ts", "", "**", "src/**/*.ts"]
    names = [(f"n{i}", g) for i, g in enumerate(globs)] + [(f"m{i}", "**/a.ts") for i in range(9)] + [("both", g) for g in globs] + [("n0", "**/a.ts"), (None, "src/*"), ("no", None)]
    got = incremental.match_globs(spark.createDataFrame(names, "name string, glob string"), spark.createDataFrame([(p,) for p in [*paths, None, "xy"]], "path string"))
    want = {(n, p) for n, g in names if g is not None for p in paths if re.search(incremental.glob_regex(g), p)}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def _sent(plan):
    """Rows that the exchanges of an executed plan wrote, those that are used again once."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _sent(plan.executedPlan())
    if "QueryStage" in name:
        return _sent(plan.plan())
    if name.startswith("ReusedExchange"):
        return 0
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if name.startswith("Exchange") else 0
    return own + sum(_sent(plan.children().apply(i)) for i in range(plan.children().size()))


def test_tiles_send_paths_once_for_many_names(spark, monkeypatch):
    monkeypatch.setattr(incremental, "ROWS", 1 << 12)
    monkeypatch.setattr(incremental, "SIDE", 1 << 6, raising=False)
    names = spark.createDataFrame([(f"n{i}", "src/*") for i in range(512)], "name string, glob string")
    found = incremental.match_globs(names, spark.createDataFrame([(f"src/f{i}",) for i in range(512)], "path string"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) == 512 * 512
    assert 2 * 512 * 8 <= _sent(found._jdf.queryExecution().executedPlan()) <= 3 * 512 * 8  # each side to eight tiles, and what else is sent once
