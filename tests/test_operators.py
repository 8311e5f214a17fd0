"""Operators on literal fixtures."""

import datetime
import hashlib
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
import plain_chunks
from factloom.operators import facts, graph, incremental, reports, retrieval, scoring
from factloom.plans import catalog
from factloom.sources import files, manifests
from factloom.streaming import sessions


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.estimate_tokens, "abcde", 2), (T.estimate_tokens, "\U0001f600" * 2, 1), (T.strip_extension, "a/b.c/d.ts", "a/b.c/d"), (T.basename, "a/b.ts", "b.ts"), (T.dirname, "b.ts", ""), (T.extname, ".env", ""), (T.line_count, "a\nb\n", 3),
        (T.todo_marker, "// TODO: x", "TODO"), (T.todo_marker, "# fixme: broken", "FIXME"), (T.todo_marker, "const TODONT = 1;", None), (T.env_refs, "process.env.A || process.env.B", ["A", "B"]), (T.env_refs, "os.getenv('X') process.env.Y", ["X", "Y"]),
        (T.env_refs, "process.env.notAVar", []), (T.env_file_var, "  BAR=1", "BAR"), (T.env_file_var, "lower=2", None), (T.issue_refs, "fix #123 see PROJ-45", ["#123", "PROJ-45"]), (T.canonical_target, "  Full Project_x ", "full-project-x"),
        (T.diagram_id, "1a-b", "n_1a_b"), (T.human_size, "1536", "1.5 KB"), (T.strip_frontmatter, "---\na: 1\n---\n\nx", "x"), (T.path_claims, "see `src/a.ts` and b.ts, src/a.ts", ["src/a.ts"]), (T.import_class, "@a/b", "scoped-package"), (T.path_claims, '{"p":["src/a.ts","x/Main.java","(b/c.tsx","n.md"," d/e.Dockerfile"]}', ["src/a.ts", "b/c.tsx", "d/e.Dockerfile"]), (T.table_cell, "a|b\\c", "a\\|b\\\\c"),
        (T.decode_cursor, "eyJvZmZzZXQiOjI1fQ", 25), (T.decode_cursor, "???", None), (T.anchor, "A (b) c", "a-b-c"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, (lambda c: f(c.cast("long"))) if f is T.human_size else f, value) == want


def test_formats(spark):
    of = lambda f, v: one(spark, lambda c: f(c.cast("long")), str(v))
    assert [of(T.short_count, n) for n in (999, 2000, 1500, 3_000_000, 1_250_000)] == ["999 tokens", "2K tokens", "1.5K tokens", "3M tokens", "1.3M tokens"]
    assert [of(T.duration, n) for n in (999, 59_999, 61_000)] == ["0s", "59s", "1m 1s"]
    assert one(spark, lambda _: T.bar(F.lit(1), F.lit(4), 4, True)) == "=---"
    assert one(spark, lambda _: T.money(F.lit(1.005))) in ("$1.00", "$1.01")
    assert one(spark, lambda _: T.cross_ref(F.lit("03-FILE-X"), F.lit("a"))) == "[FILE X](03-FILE-X.md#a)"
    assert one(spark, lambda _: T.code_ref(F.lit("./a.ts"), F.lit(3))) == "`a.ts:L3`"
    assert one(spark, T.issue_refs, "#12 x-1 abAB-7 Z9-3") == ["#12", "AB-7"]
    assert one(spark, T.env_refs, "os.getenv('A') os.environ.get('B') env::var('C') os.Getenv('D') os.getenv('E', 1)") == ["A", "C", "D"]
    assert one(spark, T.anchor, "Über_x  (y) z") == "berx-y-z"
    want = hashlib.sha256('{"sourceFile":"a","content":"q\\u000b \\\\u000B\\n\\"é"}'.encode()).hexdigest()
    assert one(spark, lambda c: T.document_fingerprint(F.lit("a"), c), 'q\x0b \\u000B\n"é') == want
    assert one(spark, lambda _: T.six_months_before(F.lit("2024-08-31")).cast("string")) == "2024-02-29"
    assert one(spark, lambda _: T.cache_share(F.lit(50), F.lit(25), F.lit(25))) == 25.0


def test_cursor_and_relevance(spark):
    assert one(spark, lambda _: T.encode_cursor(F.lit(25))) == "eyJvZmZzZXQiOjI1fQ"
    assert one(spark, lambda _: T.relevance(F.lit(0.5))) == 75.0
    assert one(spark, lambda _: T.section_path(F.lit("a"), F.lit(""), F.lit("c"))) == "a > c"
    assert one(spark, lambda _: T.suggest(F.lit("modul"), ["x", "modules"])) == ["modules"]


@pytest.mark.parametrize(
    ("src", "spec", "known", "want"),
    [("a/x.ts", "../b/y.js", ["a/x.ts", "b/y.ts"], "b/y.ts"), ("a/x.ts", "pkg", ["pkg.ts"], None), ("x.ts", "./y.js", ["y.js", "y.ts"], "y.js"), ("a/x.ts", "./y", ["a/y/index.ts"], "a/y/index.ts"), ("a/x.ts", "./y", ["a/y.ts", "a/y/index.ts"], "a/y.ts")],
)
def test_import_resolution(spark, src, spec, known, want):
    got = graph.resolve(spark.createDataFrame([(src, spec)], "src string, specifier string"), spark.createDataFrame([(k,) for k in known], "path string")).collect()
    assert [r["dst"] for r in got] == ([want] if want else [])


def test_module_graph(spark):
    edges = spark.createDataFrame([("a/x", "b/y"), ("a/x", "a/z"), ("a/x", "v")], "src string, dst string")
    member = spark.createDataFrame([("a/x", "old", 0), ("a/x", "a", 1), ("a/z", "a", 0), ("b/y", "b", 0)], "node string, grp string, seq int")
    lifted = graph.lift(edges, member)
    assert [tuple(r) for r in lifted.collect()] == [("a", "b")]
    assert [r[0] for r in graph.isolated(spark.createDataFrame([("a",), ("c",)], "node string"), lifted).collect()] == ["c"]
    held = graph.connected(spark.createDataFrame([("b", "a"), ("a", "c")], "a string, b string"), lifted).collect()
    assert {(r["a"], r["held"]) for r in held} == {("b", True), ("a", False)}


def test_steps():
    assert graph.validate_steps([("a", []), ("b", ["a"])])["cycle"] == []
    assert graph.validate_steps([("a", ["b"]), ("b", ["a"]), ("c", [])])["cycle"] == ["a", "b"]
    assert graph.validate_steps([("a", ["z"])])["unknown"] == ["z"]


def test_score_and_lock_files(spark):
    f = spark.createDataFrame([("index.ts", 20, 30, 99, 1), ("a.test.ts", 0, 0, 0, 0), ("yarn.lock", 9, 9, 9, 9), ("x/package.json", 0, 1, 0, 0), ("package.json", 0, 1, 0, 0)], "path string, importers int, exports int, changes int, todos int")
    assert {r["path"]: r["score"] for r in scoring.score(f).collect()} == {"index.ts": 100, "a.test.ts": 0, "x/package.json": 2, "package.json": 17}
    bare = scoring.score(spark.createDataFrame([("main.py",)], "path string")).first()
    assert bare["score"] == 30
    assert bare["breakdown"]["entry_point"] == 30


def test_packing_is_first_fit():
    row = lambda path, full, brief, rank, **more: {"path": path, "full": full, "summary_chars": 4 * brief, "rank": rank, "sections": [], "parsed": True, "changed": False, "score": 10} | more
    rows = pd.DataFrame([row("a", 60, 10, 1), row("b", 90, 50, 2), row("c", 35, 1, 3)])
    assert scoring.pack_plan(rows, 100)["tier"].tolist() == ["full", "skip", "full"]
    assert scoring.pack_plan(rows, 185)["tier"].tolist() == ["full", "full", "full"]
    assert scoring.pack_plan(rows, 120)["tier"].tolist() == ["full", "signatures", "signatures"]
    assert scoring.pack_plan(rows, 55, compress=True)["tokens"].tolist() == [10, 0, 1]
    part = [{"tokens": 100, "chars": 400}, {"tokens": 900, "chars": 3600}, {"tokens": 50, "chars": 200}]
    big = row("big", 9000, 20, 1, score=50, sections=part)
    plan = lambda budget, **more: scoring.pack_plan(pd.DataFrame([big | more]), budget).iloc[0]
    assert tuple(plan(8000)[["tier", "tokens"]]) == ("full", (80 + 400 + 3600 + 200 + 6 + 3) // 4)
    assert (plan(1070).tier, plan(1070).tokens) == ("full", 1072)  # labels and separators overdraw the budget
    assert (plan(200).tier, plan(200).taken) == ("signatures", [0, 2])
    assert (plan(30).tier, plan(30).taken, plan(30).tokens) == ("signatures", [], 20)
    assert plan(19).tier == "skip"
    assert plan(8999, changed=True)["shape"] == "sections"
    assert plan(8500, parsed=False).tier == "signatures"
    unreadable = pd.DataFrame([row("x", None, 1, 1), row("y", 10, 1, 2)])
    assert scoring.pack_plan(unreadable, 5)["tier"].tolist() == ["skip", "signatures"]


def test_chunks():
    starts, text = [], "".join(chr(0x4E00 + i % 20000) for i in range(7000))
    for w in plain_chunks.windows(text):
        starts.append((text.index(w), len(w)))
    assert starts == [(0, 2048), (2048, 2048), (3796, 2048), (5544, 1456)]
    assert [len(w) for w in plain_chunks.windows("word " * 2000)] == [2044] * 5 + [974]
    pairs = plain_chunks.chunk_text("# H\n" + "\U0001f600 " * 700)
    assert [len(c["content"].encode("utf-16-le")) // 2 for c in pairs] == [2046, 56]
    assert plain_chunks.windows(" " * 3000 + "x" * 10) == ["x" * 10]
    blank = plain_chunks.chunk_text("\n \n# A\nx")
    assert [(c["h1"], c["content"]) for c in blank] == [("", ""), ("A", "# A\nx")]
    long = plain_chunks.chunk_text("# A\n" + "  " * 1500 + "y")  # trimmed before it is measured
    assert len(long) == len(plain_chunks.windows("# A\n" + "  " * 1500 + "y"))
    got = plain_chunks.chunk_text("# A\nx\n## B\ny\n### C\nz\n# D\nw")
    assert [(c["h1"], c["h2"], c["h3"]) for c in got] == [("A", "", ""), ("A", "B", ""), ("A", "B", "C"), ("D", "", "")]
    assert plain_chunks.chunk_text("  \n") == []
    assert len(plain_chunks.chunk_text("x" * 9000)) == 1


def test_manifests(spark):
    rows = [
        ("a/package.json", '{"dependencies":{"x":"1"},"optionalDependencies":{"y":"2"}}'), ("Cargo.toml", '[dependencies]\nserde = "1"\ntokio = {version = "2"}\n[dev-dependencies]\nq = {path = "."}'), ("go.mod", "require (\n\t// no v0\n\ta.b/c v1.0.0 // indirect\n)\nrequire d.e/f v2.0.0\n"),
        ("requirements.txt", "# no\nflask==1.0\n-r x\nbare\n  django[x]>=2 # why\n_o ~= 1 # c\n--index y\n"), ("pyproject.toml", '[project]\ndependencies=["a>=1"]\n[project.optional-dependencies]\ndev=["b"]'), ("b/Cargo.toml", "not = [toml"),
    ]
    got = {(r["name"], r["version"], r["type"]) for r in manifests.dependencies(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("x", "1", "production"), ("y", "2", "optional"), ("serde", "1", "production"), ("tokio", "2", "production"), ("q", "*", "development"), ("a.b/c", "v1.0.0", "production"), ("d.e/f", "v2.0.0", "production"), ("flask", "==1.0", "production"), ("bare", "*", "production"), ("django", "*", "production"), ("_o", "~= 1 # c", "production"), ("a", "a>=1", "production"), ("b", "b", "development")}


def test_discovery_and_git(spark, tmp_path):
    for name, content in {"a.py": b"x", "node_modules/b.js": b"y", "img.PNG": b"z", ".hidden": b"h", "d/e.ts": b"e", "big.txt": b"0" * (files.MAX_BYTES + 1)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert sorted(r["path"] for r in files.discover(spark, str(tmp_path)).collect()) == ["a.py", "d/e.ts"]
    for name in ("logs/x.log", "keep.log", "gen/a.ts", "sub/gen/b.ts", "sub/only.ts", "only.ts", "ends.tsx"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / ".gitignore").write_text("# c\n*.log\n!keep.log\ngen/\n/only.ts\n")
    assert sorted(r["path"] for r in files.discover(spark, str(tmp_path), ["**/*.tsx"]).collect()) == ["a.py", "d/e.ts", "keep.log", "sub/only.ts"]
    log = files.git_log(spark.createDataFrame([("h|a|e|2024-01-31T23:00:00-05:00|fix | pipes",), ("",)], "value string")).collect()
    assert [(r["author"], r["message"]) for r in log] == [("a", "fix | pipes")]
    assert facts.by_month(spark.createDataFrame(log)).first()["month"] == "2024-01"


def test_incremental(spark):
    claims = spark.createDataFrame([("r1", "a"), ("r2", "b")], "renderer string, path string")
    infra = spark.createDataFrame([("i",)], "path string")
    hit, lost = incremental.affected(spark.createDataFrame([("a",), ("i",), ("z",)], "path string"), claims, infra)
    assert [r["renderer"] for r in hit.collect()] == ["r1"]
    assert [r["path"] for r in lost.collect()] == ["z"]
    registry = spark.createDataFrame([("index",), ("r1",), ("r2",)], "renderer string")
    plan = {r["renderer"]: r["decision"] for r in incremental.dry_run(registry, hit, lost.limit(0)).collect()}
    assert plan == {"index": "execute", "r1": "execute", "r2": "skip"}
    known = spark.createDataFrame([("src/a/b.ts",), ("src/c.ts",), ("x.md",)], "path string")
    assert sorted(r["path"] for r in incremental.expand_globs([("r", "src/**/*.ts")], known).collect()) == ["src/a/b.ts", "src/c.ts"]
    rate = incremental.validation_summary(incremental.validate(known.limit(0), known, ["path"])).first()["drop_rate"]
    assert rate == 0.0


def test_evidence_and_upsert(spark):
    m = lambda rows: retrieval.evidence(spark.createDataFrame(rows, "relevance double, source_file string")).first()["weak"]
    assert not m([(80.0, "a"), (75.0, "b")])
    assert m([])
    assert m([(90.0, "a")])
    with pytest.raises(ValueError, match="SEARCH_INVALID_TOP_K"):
        retrieval.knn(None, [], 0)
    t = retrieval.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert sorted(map(tuple, t.collect())) == [(1, "a"), (2, "c")]


def test_knn_batch_takes_every_query(spark):
    rows = [(i, [float(i // 3), 0.0]) for i in range(3000)] + [(3000, None), (3001, [1.0]), (3002, [None, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = e.filter("vec_id < 3000 and vec_id % 7 = 0 or vec_id = 3000").selectExpr("vec_id as query_id", "embedding as vector")
    got = {}
    for r in retrieval.knn_batch(e, q, 4, "query_id", "vec_id").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    plain = lambda v: sorted((abs(i // 3 - v // 3), i) for i in range(3000))[:4]
    assert got == {v: [(i, float(d)) for d, i in plain(v)] for v in range(0, 3000, 7)} | {3000: [(i, None) for i in range(4)]}
    few = retrieval.knn_batch(e.filter("vec_id >= 2999"), q.filter("query_id = 7"), 9, "query_id", "vec_id").orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in few] == [(2999, 997.0), (3000, None), (3001, None), (3002, None)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_knn_batch_follows_the_table(spark):
    got = catalog.QUERIES["knn_batch"](spark, "/root/testdata/sf0.1").groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 5 for i in range(0, 2000, 50)}


def test_sessions(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "progress"), (1, 2, "final"), (2, 1, "progress"), (2, 3, "progress")], "session_id long, sequence long, kind string")
    assert [r["ok"] for r in sessions.check_sequence(e).orderBy("session_id", "sequence").collect()] == [True, True, True, False]
    assert {r["session_id"]: r["status"] for r in sessions.status(e).collect()} == {1: "completed", 2: "active"}
    moves = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "queued"), (2, 1, "running")], "job_id int, seq int, state string")
    assert [r["ok"] for r in sessions.check_moves(moves).orderBy("job_id", "seq").collect()] == [True, True, False, False]
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions.append(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["session_id"], r["sequence"], r["ok"]) for r in spark.table("sess").collect()) == [(1, 1, True), (1, 2, True), (2, 1, True), (2, 3, False)]


def test_branches(spark):
    b = spark.createDataFrame([("develop", datetime.datetime(2024, 1, 1)), ("release/1", datetime.datetime(2024, 3, 1))], "name string, commit_ts timestamp")
    assert facts.branch_strategy(b).first()[0] == "git-flow"
    assert [r["age"] for r in facts.branch_age(b, F.lit("2024-04-01").cast("date")).orderBy("name").collect()] == ["stale", "between"]


def test_report_rules(spark):
    assert one(spark, lambda _: reports.framework(F.lit("contests/a.rs"))) is None
    assert one(spark, lambda _: reports.framework(F.lit("tests/a/b.rs"))) == "rust_test"
    assert one(spark, lambda _: reports.framework(F.lit("a/test_x.py"))) == "pytest"
    assert one(spark, lambda _: reports.layer(F.lit("src/serviceModels"))) == "service"
    assert one(spark, lambda _: reports.ci_provider(F.lit("x/.GITHUB/workflows/a.yml"))) == "GitHub Actions"
    assert one(spark, lambda _: T.specificity(F.lit("src/a.ts"))) == 2.0


def test_locations_order_and_cap(spark):
    refs = spark.createDataFrame([("A", "b", 10), ("A", "b", 9), ("A", "a", 3), ("B", "c", 1)], "variable string, file string, line int")
    got = {r.variable: (r.refs, r.locations) for r in reports.locations(refs, 2).collect()}
    assert got == {"A": (3, ["a:3", "b:9"]), "B": (1, ["c:1"])}


def test_reports_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert reports.severities(none("severity string")).first().asDict() == {"critical": 0, "warning": 0, "info": 0}
    assert reports.inline_doc_coverage(none("path string, content string")).first().asDict() == {"sampled": 0, "documented": 0, "percent": 0}
    assert [r.status for r in reports.round_table(none("round long, status string, validated long, corrected long")).collect()] == ["skipped"] * 6
    assert reports.conventions(none("module string, pattern string, description string, seq long")).count() == 0


def test_config_diff_and_cache(spark):
    own = spark.createDataFrame([("a", "1"), ("b", None), ("x", "1")], "key string, value string")
    defaults = spark.createDataFrame([("a", "2"), ("b", None), ("c", "3")], "key string, value string")
    assert {r.key: r.action for r in reports.config_diff(own, defaults).collect()} == {"a": "customized", "b": "at-default", "c": "missing", "x": "unknown"}
    keys = spark.createDataFrame([(1, "h"), (2, "i"), (3, "j")], "round int, hash string")
    cache = spark.createDataFrame([(1, "h", 2, "r"), (2, "i", 1, "r"), (3, "old", 2, "r")], "round int, hash string, version int, result string")
    assert {r["round"]: r.hit for r in reports.cached_rounds(keys, cache, 2).collect()} == {1: True, 2: False, 3: False}
    plan = reports.reindex_plan(spark.createDataFrame([(1, "f"), (2, "g")], "doc_id int, fingerprint string"), spark.createDataFrame([(1, "f")], "doc_id int, fingerprint string"))
    assert {r.doc_id: r.action for r in plan.collect()} == {1: "skip", 2: "index"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_whole_tables_shape_the_answer(spark):
    run = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    table = lambda name: catalog.load(spark, "/root/testdata/sf0.001", name)
    assert run("isolated_modules").count() == 0
    rounds = {r["round"]: (r.validated or 0) + (r.corrected or 0) for r in run("round_table").collect()}
    assert rounds == {1: 0} | {r.turn + 2: r["count"] for r in table("conversations").groupBy("turn").count().collect()}
    known = {r[0] for r in table("customer").select("c_nationkey").distinct().collect()}
    assert all((r.role != "-") == (r.s_nationkey in known) for r in run("dependency_roles").collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_renderers_of_every_region(spark):
    table = lambda name: catalog.load(spark, "/root/testdata/sf0.1", name)
    hit = table("supplier").filter("s_acctbal < 0 and s_suppkey <> 3").join(table("nation"), F.expr("n_nationkey = s_nationkey"))
    got = {r.renderer for r in catalog.QUERIES["renderer_filter"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {r[0] for r in hit.select("n_name").collect()}
    assert len(got) > 20


def test_contrived_cases(spark):
    deps = spark.createDataFrame([("a", "x", "production"), ("b", "y", "optional")], "name string, dep string, type string")
    roles = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "name string, role string, seq long")
    assert {r.dep: (r.role, r.section) for r in reports.with_role(deps, roles).collect()} == {"x": ("new", "production"), "y": ("-", "peer")}
    done = spark.createDataFrame([(2, "success", 1, 2), (5, "success", 3, None), (8, "success", 4, 4)], "round long, status string, validated long, corrected long")
    assert [r.status for r in reports.round_table(done, 8).orderBy("round").collect()] == ["skipped", "success", "skipped", "skipped", "success", "skipped", "skipped", "success"]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert [r.node for r in graph.isolated(nodes, spark.createDataFrame([(1, 3)], "a long, b long")).collect()] == [2]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_every_contributor(spark):
    users = catalog.load(spark, "/root/testdata/sf0.1", "events").selectExpr("user_id % 40", "user_id % 60").distinct().count()
    assert catalog.QUERIES["contributors_all"](spark, "/root/testdata/sf0.1").count() == users > 10


def test_links_of_whole_pages(spark, tmp_path):
    body = "<p>x & y</p>\n" * 20_000
    html = f'{body}<a href="a/b.md">1</a><a href="c.md#d">2</a><a href="https://h/e.md">3</a><a href=".md">4</a><a href="#f.md">5</a>{body}<a href="g.md?q">6</a><a href="x\ny.md">7</a>'
    want = html.replace("a/b.md", "a/b.html").replace("c.md#d", "c.html#d").replace("#f.md", "#f.html").replace("y.md", "y.html")
    spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.escaped, r.rewritten) for r in catalog.QUERIES["html_link_rewrite"](spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (digest(html.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")), digest(want)), 2: (None, None)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(catalog.SQL["html_link_rewrite"]).fetchall()} == got
