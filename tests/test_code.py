"""Symbols, packing inputs, searches, the index, steps, sessions, snapshots and sites on literal fixtures."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import facts, incremental, predicates, reindex, retrieval, rounds, scoring, steps
from factloom.sources import settings, site, snapshots
from factloom.streaming import sessions
from factloom.symbols import extract, golang, patterns, pysource, rustlang, script
from factloom.symbols.tokens import bare

TS = """// header
import def, { a as b, type C } from './x';
import type { T } from 'z';
/** Doc of f */
export async function f<T extends Foo>(a: Map<string, number>, { x }: P = {}, ...rest: string[]): Promise<T> {
  const r = /[)}"']/g; return `a ${ {b: `}`} } "`;
}
function over(x: string): void;
export const K: number = 3, arrow = async (x: number): Promise<void> => { y() };
const local = x => x + 1
export default class Foo<T> extends Base<T> implements I<A, B>, J {
  private readonly x: number = 1;
  #z = 2;
  /** m doc */
  async m(a: string): Promise<{ k: number }> { return { k: 1 }; }
  get v(): number { return 1 }
  protected static s<U>(u: U) {}
  abstract q(): void;
}
export interface IF<T> extends A<T>, B { a: string; readonly b?: { c: number }; m(x: number): void; (call: string): void }
export enum E { A, B }
export type X = { a: string } | number;
export * as ns from './ns';
export { p, q as r };
export { s as default } from './s';
if (a) { b() } else { c() }
@Comp({ a: 1 })
export class Dec { }
export default foo;
"""


def test_typescript():
    got = script.extract(TS, "typescript")
    assert [(f["name"], f["is_async"], f["line"], f["end_line"], f["docstring"], f["return_type"]) for f in got["functions"]] == [("f", True, 5, 7, "Doc of f", "Promise<T>"), ("arrow", True, 9, 9, None, "Promise<void>"), ("local", False, 10, 10, None, None)]
    assert [(p["name"], p["type"], p["default_value"], p["is_rest"]) for p in got["functions"][0]["parameters"]] == [("a", "Map<string, number>", None, False), ("{ x }", "P", "{}", False), ("...rest", "string[]", None, True)]
    foo, iface, dec = got["classes"]
    assert (foo["extends"], foo["implements"], foo["end_line"]) == (["Base"], ["I<A, B>", "J"], 19)
    assert [(m["name"], m["visibility"], m["decorators"], m["docstring"]) for m in foo["methods"]] == [("m", "public", [], "m doc"), ("get v", "public", [], None), ("s", "protected", ["@static"], None)]
    assert [(f["name"], f["type"], f["visibility"], f["is_readonly"]) for f in foo["fields"]] == [("x", "number", "private", True), ("#z", None, "private", False)]
    assert (iface["extends"], [f["name"] for f in iface["fields"]], [m["name"] for m in iface["methods"]]) == (["A<T>", "B"], ["a", "b"], ["m"])
    assert dec["decorators"] == ["@Comp({ a: 1 })"]
    assert [(e["name"], e["kind"], e["is_re_export"]) for e in got["exports"]] == [
        ("f", "function", False), ("K", "variable", False), ("arrow", "function", False), ("default", "default", False), ("IF", "interface", False), ("E", "enum", False), ("X", "type", False), ("ns", "namespace", True), ("p", "variable", False),
        ("r", "variable", False), ("default", "re-export", True), ("Dec", "class", False), ("default", "default", False),
    ]
    assert [(i["source"], i["is_type_only"], [(s["name"], s["alias"], s["is_default"]) for s in i["specifiers"]]) for i in got["imports"]] == [("./x", False, [("def", None, True), ("a", "b", False), ("C", None, False)]), ("z", True, [("T", None, False)])]
    jsx = script.extract("export function D(a, {b}) { return (<A/>) }\n", "jsx")["functions"][0]
    assert jsx["decorators"] == ["@component"]
    assert [p["name"] for p in script.extract("function g(a, {b}, c = 1, ...d) {}", "javascript")["functions"][0]["parameters"]] == ["a", "d"]


def test_python():
    got = pysource.extract('import os, a.b as c\nfrom ..m import y as z\n# the doc\nMAX: int = 3\nA = B = [1,\n 2]\n__all__ = ["f"]\n@dec(1)\nasync def f(a, *args, d="x", **kw) -> int:\n    """Doc\n\n      more\n    """\nclass K(Base, metaclass=M):\n    attr: int = 1\n    def __init__(self, q):\n        self._q = q\n    def __x(self): ...\n')
    f, k = got["functions"][0], got["classes"][0]
    assert (f["decorators"], f["docstring"], f["line"], f["end_line"], [(p["name"], p["type"], p["is_rest"]) for p in f["parameters"]]) == (["@dec(1)"], "Doc\n\nmore", 9, 13, [("a", None, False), ("args", None, True), ("d", None, False), ("kw", "dict", True)])
    assert (k["extends"], [(x["name"], x["is_static"], x["visibility"]) for x in k["fields"]], [(m["name"], m["visibility"]) for m in k["methods"]]) == (["Base"], [("attr", True, "public"), ("_q", False, "protected")], [("__init__", "public"), ("__x", "private")])
    assert [(c["name"], c["value"], c["docstring"]) for c in got["constants"]] == [("MAX", "3", "the doc"), ("A", "B = [1,\n 2]", None)]
    assert [e["name"] for e in got["re_exports"]] == ["f"]
    assert [(i["source"], i["specifiers"][0]["name"]) for i in got["imports"]] == [("os", "os"), ("..m", "y")]
    assert pysource.extract("def (")["parse_errors"]


def test_go_and_rust():
    got = golang.extract("package m\nimport (\n\t_ \"x/y\"\n)\n// Foo doc\ntype Foo struct {\n\tA, b int `json:\"a\"`\n\t*Base\n}\ntype I interface {\n\tDo(a int) error\n\tfmt.Stringer\n}\nfunc (f *Foo) Go() {}\nfunc (z Zed) Lost(int, string) {}\nconst (\n\tA = iota\n\tb\n)\n")
    assert [(c["name"], c["extends"], c["docstring"], [m["name"] for m in c["methods"]], [(f["name"], f["type"]) for f in c["fields"]]) for c in got["classes"]] == [("Foo", ["Base"], "Foo doc", ["Go"], [("A", "int"), ("b", 'int `json:"a"`')]), ("I", ["fmt.Stringer"], None, ["Do"], [])]
    assert [(f["name"], [p["name"] for p in f["parameters"]]) for f in got["functions"]] == [("Lost", ["_", "_"])]
    assert [(c["name"], c["value"]) for c in got["constants"]] == [("A", "iota")]
    got = rustlang.extract("use a::{b, c::D as E};\npub use x::*;\n/// Doc\n#[derive(Debug)]\npub struct S<T> { pub a: T }\nimpl S<T> { pub fn new() {} }\npub enum En { A, B(i32) }\nimpl Tr for En { fn go(&self, x: u8) {} }\nmod inner { fn hidden() {} }\nstatic N: char = '}';\n")
    assert [(c["name"], c["docstring"], c["decorators"], c["implements"], [m["name"] for m in c["methods"]]) for c in got["classes"]] == [("S", "Doc", ["#[derive(Debug)]"], [], []), ("En", None, [], ["Tr"], ["go"])]
    assert [f["name"] for f in got["functions"]] == ["new"]
    assert [(i["source"], i["specifiers"][0]["name"], i["specifiers"][0]["alias"]) for i in got["imports"]] == [("a::", "b", None), ("a::c", "D", "E"), ("x", "*", None)]
    assert [(e["name"], e["kind"]) for e in got["exports"]] == [("En", "enum"), ("new", "function"), ("S", "class")]


def test_patterns_and_dispatch(spark):
    got = patterns.extract("import java.util.*;\n/**\n * Doc\n */\npublic class Foo<T> extends Bar {\n  private int add(int a, List<String> b) {\n    if (x) { }\n", "java")
    assert [(c["name"], c["extends"], c["docstring"]) for c in got["classes"]] == [("Foo", ["Bar"], "Doc")]
    assert [(f["name"], f["visibility"], [(p["name"], p["type"]) for p in f["parameters"]]) for f in got["functions"]] == [("add", "private", [("a", "int"), ("b", "List<String>")])]
    assert patterns.extract("x = 1", "lua")["parse_errors"][0]["message"] == "no line matches a pattern of a function, class or import"
    assert patterns.extract("  \n", "lua")["parse_errors"] == []
    assert [bare(x) for x in ("/** a\n * b\n */", "/// c", "# d")] == ["a\nb", "c", "d"]
    assert (extract.language_of("a.d.ts"), extract.language_of("a.R"), extract.language_of("a.TS"), extract.language_of("Makefile")) == ("typescript", "r", None, None)
    files = spark.createDataFrame([("a.ts", TS), ("b.xyz", "x"), ("c.py", None), ("d.py", "def ("), ("d.go", "func \x00("), ("e.ts", "{[(" * 50)], "path string, content string")
    rows = {r["path"]: r for r in extract.parse(files).collect()}
    assert rows["a.ts"]["ast"]["line_count"] == TS.count("\n") + 1
    assert (rows["b.xyz"]["ast"]["language"], rows["b.xyz"]["ast"]["parse_errors"][0]["message"]) == ("unknown", "Unsupported file type")
    assert rows["c.py"]["ast"] is None
    assert rows["d.py"]["ast"]["parse_errors"]
    assert rows["d.go"]["ast"] is not None
    assert {r["language"]: (r["files"], r["functions"]) for r in extract.totals(extract.parse(files.filter("path = 'a.ts'"))).collect()} == {"typescript": (1, 3)}
    case = spark.createDataFrame([("MAX_1", "__a__", "Up")], "a string, b string, c string").select(extract.constant_case("a"), extract.by_underscore("b"), extract.by_case("c")).first()
    assert tuple(case) == (True, "public", "public")


def test_extractors_survive_any_text():
    import random

    rng = random.Random(5)
    marks = ["{", "}", "(", ")", "[", "]", "<", ">", "=>", ":", ",", ";", "class ", "export ", "function ", "fn ", "func ", "type ", "impl ", "use ", "import ", "\n", "x ", "'", '"', "`", "/*", "*/", "//", "#", "@", "=", "*", "struct ", "interface ", "default "]
    for _ in range(300):
        text = "".join(rng.choice(marks) for _ in range(60))
        for read in (script.extract, golang.extract, rustlang.extract, patterns.extract, pysource.extract):
            read(text, "typescript")


@pytest.mark.parametrize(
    ("path", "entry", "config", "test"),
    [
        ("packages/a/index.ts", 30, 0, 0), ("index.d.ts", 30, 0, 0), ("src/server.test.ts", 30, 0, -15), ("main.js", 30, 0, 0), ("utils.ts", 0, 0, 0), ("cli.ts", 30, 0, 0), ("bin/cli.ts", 0, 0, 0), ("Cargo.toml", 0, 15, 0), ("go.mod", 0, 15, 0),
        ("Makefile", 0, 15, 0), (".env.local", 0, 15, 0), (".eslintrc.json", 0, 15, 0), ("sub/package.json", 0, 0, 0), ("a/Dockerfile", 0, 0, 0), ("src/tsconfig.json", 0, 0, 0), ("docker-compose.yml", 0, 0, 0), ("tests/a.py", 0, 0, 0),
        ("a/__test__/b.ts", 0, 0, -15), ("a/x.config.js", 0, 15, 0),
    ],
)
def test_scores(spark, path, entry, config, test):
    r = scoring.score(spark.createDataFrame([(path, 2)], "path string, todos int")).first()
    assert (r["breakdown"]["entry_point"], r["breakdown"]["config_file"]) == (entry, config)
    assert r["score"] == max(0, entry + config + test + 10)


def test_importers_without_extension(spark):
    files = spark.createDataFrame([("a/x.ts",), ("a/y.ts",), ("a/z.ts",)], "path string")
    known = spark.createDataFrame([("a/x", 2), ("a/y.ts", 3), ("a/y", 9)], "path string, importers int")
    assert {r["path"]: r["score"] for r in scoring.score(files, [known]).collect()} == {"a/x.ts": 6, "a/y.ts": 9, "a/z.ts": 0}
    order = scoring.by_score(spark.createDataFrame([("b", 1), ("B", 1), ("a", 1), ("c", 2)], "path string, score int")).collect()
    assert [r["path"] for r in order] == ["c", "a", "b", "B"]


def test_packed_contents(spark):
    big = "export function one() {\n" + "  // filler filler filler\n" * 1500 + "}\nexport function two() { return 2 }\nfunction plain() {}\nfunction odd() { /* FIXME */ }\n"
    files = spark.createDataFrame([("big.ts", big), ("pad.ts", "p" * 60_000), ("gone.ts", None), ("n.yml", "k: 1\n" * 30)], "path string, content string")
    parsed = extract.parse(files).drop("warning").withColumns({"score": F.when(F.col("path") == "big.ts", 50).otherwise(1), "changed": F.lit(False), "rank": F.element_at(F.create_map(*(F.lit(x) for p, r in (("big.ts", 1), ("pad.ts", 2), ("gone.ts", 3), ("n.yml", 4)) for x in (p, r))), F.col("path")).cast("long")})
    parsed = parsed.withColumn("ast", F.when(F.col("path") != "n.yml", F.col("ast")))
    labels = [s["label"] for s in parsed.filter("path = 'big.ts'").select(F.explode(scoring.sections()).alias("s")).select("s.*").collect()]
    assert labels == ["Export: one", "Export: two", "Edge case: odd"]
    packed = scoring.pack(scoring.costs(parsed), 400)
    got = {r["path"]: r for r in scoring.packed_content(packed, parsed.select("path", "content", "ast")).collect()}
    assert {p: r["tier"] for p, r in got.items()} == {"big.ts": "signatures", "pad.ts": "signatures", "gone.ts": "skip", "n.yml": "full"}
    assert "// --- Export: two ---\nexport function two() { return 2 }" in got["big.ts"]["content"]
    assert "Export: one" not in got["big.ts"]["content"]
    for p in ("big.ts", "n.yml"):
        assert got[p]["tokens"] == -(-len(got[p]["content"]) // 4)
    total = scoring.packing_summary(packed, 400).first()
    assert (total["files"], total["full"], total["signatures"], total["skip"]) == (4, 1, 2, 1)
    brief = files.filter("path = 'n.yml'").select(scoring.fallback_summary("path", "content")).first()[0].split("\n")
    assert (brief[0], brief[1], len(brief), brief[-1]) == ("// FILE: n.yml (31 lines)", "// k: 1", 22, "// ... (11 more lines)")
    assert scoring.pack(scoring.costs(parsed.limit(0)), 10).count() == 0


def test_evidence(spark):
    judge = lambda rows: retrieval.evidence(spark.createDataFrame(rows, "relevance double, source_file string")).first()
    assert not judge([(80.0, "a"), (75.0, "b")])["weak"]
    assert judge([])["reasons"] == ["Nothing in the index matches."]
    assert (judge([(90.0, "a"), (60.0, "b")])["weak"], judge([(90.0, "a"), (60.0, "b")])["conflicting"]) == (True, True)
    weak = judge([(57.0, "a"), (50.0, "b")])
    assert (weak["conflicting"], weak["reasons"]) == (False, ["The best match has 57.00% of the 58.00% that it needs."])
    assert judge([(50.0, "a"), (90.0, "b")])["top"] == 90
    assert not judge([(80.0, "a")])["conflicting"]


def test_search_and_answers(spark):
    c = spark.createDataFrame([("d", "modules", f"f{i % 2}.md", i, "S", "p", f" body {i} ", [float(i), 0.0]) for i in range(6)], "doc_id string, doc_type string, source_file string, chunk_index int, section_path string, content_preview string, content string, embedding array<float>")
    found, info = retrieval.search(c, " q ", lambda q: [0.1, 0.0], 4, [" Modules "])
    assert (info["query"], info["types"], info["indexed"], info["available"], info["far"]) == ("q", ["modules"], 6, ["modules"], False)
    assert [r["chunk_index"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 3]
    assert [r["content"] is None for r in retrieval.tool_results(found).orderBy("rank").collect()] == [False, False, False, True]
    answer = retrieval.answers(found.withColumn("relevance", 60 + F.col("relevance") / 100), name="why").first()
    assert (answer["kind"], len(answer["citations"]), answer["context"].startswith("[1]\nsource_file: f0.md")) == ("answer", 4, True)
    back = retrieval.answers(found.withColumn("relevance", F.lit(10.0)), name="why").first()
    assert (back["kind"], back["context"]) == ("clarification", None)
    assert back["question"].startswith('Before "why" can be answered: The best match')
    assert [r["line"] for r in retrieval.footnotes(retrieval.citations(found)).orderBy("place").collect()][0] == "[1] f0.md :: S (chunk 0)"
    assert [r[0] for r in retrieval.sources(found).collect()] == ["f0.md", "f1.md"]
    empty, info = retrieval.search(c.limit(0), "q", lambda q: pytest.fail("nothing is indexed"))
    assert (empty.count(), info["indexed"]) == (0, 0)
    for code, call in {"SEARCH_EMPTY_QUERY": lambda: retrieval.search(c, " ", None), "SEARCH_UNKNOWN_TYPE": lambda: retrieval.search(c, "q", None, types=["nope"]), "SEARCH_INVALID_TYPE": lambda: retrieval.search(c, "q", None, types=[" "]), "SEARCH_INVALID_TOP_K": lambda: retrieval.search(c, "q", None, 0)}.items():
        with pytest.raises(retrieval.SearchError) as e:
            call()
        assert e.value.code == code


def test_routes_and_indexes():
    assert retrieval.route("remote-only", "r") == ("r", "remote")
    assert retrieval.route("local-preferred", "r", "l", lambda x: None) == ("l", "local")
    assert retrieval.route("local-preferred", "r", "l", lambda x: "down", True, lambda p: True) == ("r", "remote")
    sick = lambda x: "down"
    for code, args in {"EMBEDDING_LOCAL_PROVIDER_MISSING": ("local-only", "r"), "EMBEDDING_LOCAL_UNAVAILABLE": ("local-only", "r", "l", sick), "EMBEDDING_CONFIRMATION_REQUIRED": ("local-preferred", "r", "l", sick), "EMBEDDING_CONFIRMATION_HANDLER_MISSING": ("local-preferred", "r", "l", sick, True), "EMBEDDING_FALLBACK_DECLINED": ("local-preferred", "r", "l", sick, True, lambda p: False)}.items():
        with pytest.raises(retrieval.SearchError) as e:
            retrieval.route(*args)
        assert e.value.code == code
    assert (retrieval.dimensions(3, None, "m"), retrieval.dimensions(0, ("m", 5), "m"), retrieval.dimensions(0, None, "m", lambda: 7)) == (3, 5, 7)
    retrieval.check_index(None, "m", 3)
    retrieval.check_index(("old", 3), "m", 3, writing=True)
    for stored, writing in ((("old", 3), False), (("m", 4), True)):
        with pytest.raises(retrieval.SearchError):
            retrieval.check_index(stored, "m", 3, writing)
    with pytest.raises(retrieval.SearchError):
        retrieval.dimensions(0, ("other", 3), "m")


def test_reindex(spark):
    docs = spark.createDataFrame([("a", "t", "a.md", "# A\nx\n## B\ny"), ("b", "t", "b.md", "plain"), ("c", "t", "c.md", " ")], "doc_id string, doc_type string, source_file string, content string")
    embed = lambda rows: rows.select("key", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    index, outcome = reindex.reindex(docs, reindex.new(spark, "m", 2), embed, "m", 2)
    assert {r["doc_id"]: (r["action"], r["chunks"]) for r in outcome.collect()} == {"a": ("index", 2), "b": ("index", 1), "c": ("index", 0)}
    assert sorted((r["doc_id"], r["chunk_index"], r["embedding"][0]) for r in index.chunks.collect()) == [("a", 0, 5.0), ("a", 1, 6.0), ("b", 0, 5.0)]
    again, outcome = reindex.reindex(docs.withColumn("content", F.when(F.col("doc_id") == "b", "changed!").otherwise(F.col("content"))), index, embed, "m2", 2)
    assert reindex.summary(outcome).first().asDict() == {"processed": 1, "skipped": 2, "failed": 0, "total": 3, "chunks": 1}
    assert sorted((r["doc_id"], r["content"]) for r in again.chunks.filter("doc_id = 'b'").collect()) == [("b", "changed!")]
    assert again.meta["embedding_model"] == "m2"
    partial = lambda rows: embed(rows).filter("key != 'a#1'")
    kept, outcome = reindex.reindex(docs.filter("doc_id = 'a'").withColumn("content", F.lit("# A\nnew\n## B\nnew")), index, partial, "m", 2)
    assert [r["action"] for r in outcome.collect()] == ["failed"]
    assert kept.chunks.filter("content like '%new%'").count() == 0
    assert [r["stored"] is None for r in reindex.fingerprints(docs.filter("doc_id = 'a'"), index).collect()] == [False]
    forced, outcome = reindex.reindex(docs, index, embed, "m", 2, force=True)
    assert reindex.summary(outcome).first()["processed"] == 3
    with pytest.raises(retrieval.SearchError):
        reindex.reindex(docs, index, embed, "m", 3)


def test_steps(spark):
    seen = []

    def fail(done):
        raise RuntimeError("x")

    made = steps.run([steps.Step("a", [], lambda d: 1), steps.Step("b", ["a"], fail), steps.Step("c", ["b"], lambda d: 3), steps.Step("d", ["a"], lambda d: d["a"].value + 1), steps.Step("e", ["c", "d"], lambda d: 0)], 2, lambda n, w: seen.append((n, w)))
    assert {n: o.status for n, o in made.items()} == {"a": "completed", "b": "failed", "c": "skipped", "d": "completed", "e": "skipped"}
    assert made["d"].value == 2
    assert ("c", "started") not in seen
    with pytest.raises(ValueError, match="cycle"):
        steps.run([steps.Step("a", ["b"], fail), steps.Step("b", ["a"], fail)])
    assert steps.run([]) == {}


def test_sessions_accept_sequences(spark, tmp_path):
    ok = lambda seq, end, last=0, ended=False: sessions.accepted(np.array(seq), np.array(end, bool), last, ended).tolist()
    assert ok([1, 2, 2, 3, 5], [0] * 5) == [True, True, False, True, False]
    assert ok([2, 6], [0, 0], 5) == [False, True]
    assert ok([1, 2, 3], [1, 1, 0]) == [True, False, False]
    assert ok([4, 5], [0, 1], 3, True) == [True, True]
    assert ok([], []) == []
    at = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, 1, "final", at), (2, 1, "progress", at)], "session_id long, sequence long, kind string, at timestamp")
    assert [r["session_id"] for r in sessions.kept(e, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()] == [2]
    assert sessions.kept(e, F.lit("2024-01-01 23:59:59").cast("timestamp")).count() == 2
    assert [tuple(r) for r in sessions.cancel(e, e.select("session_id").distinct()).collect()] == [(2, 2, "cancelled")]
    assert [r[0] for r in spark.createDataFrame([("queued",), ("failed",)], "s string").select(sessions.progress("s")).collect()] == [5, 100]
    e.drop("at").coalesce(1).write.parquet(str(tmp_path / "in"))
    heard = []
    q = sessions.fan_out(spark.readStream.schema(e.drop("at").schema).parquet(str(tmp_path / "in")), [lambda rows, n: heard.append(sorted(r["session_id"] for r in rows.collect()))] * 2, str(tmp_path / "cp"), {1: 1})
    q.awaitTermination(60)
    assert heard == [[2], [2]]
    r = spark.createDataFrame([(1, " Full  Docs", 1), (2, "full_docs", 2), (3, "x", 3)], "request long, target string, seq long")
    j = spark.createDataFrame([(9, "X", "running"), (8, "full-docs", "completed")], "job long, target string, state string")
    assert sorted((x["request"], x["job"], x["joined"]) for x in sessions.join_in_flight(r, j).collect()) == [(1, 1, False), (2, 1, True), (3, 9, True)]


def test_predicates(spark):
    f = spark.createDataFrame([(p,) for p in ("README", "docs/a.ts", "b.md", "src/utils/x.ts", "a/types.ts", "src/types2.ts", ".env.prod", "x/go.mod", "readme.rst")], "path string")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(f.filter(predicates.is_readme("path"))) == ["README", "readme.rst"]
    assert paths(predicates.doc_files(f)) == ["b.md", "docs/a.ts", "readme.rst"]
    assert paths(f.filter(predicates.is_infrastructure("path"))) == ["a/types.ts", "src/utils/x.ts"]
    assert paths(f.filter(predicates.is_env_file("path") | predicates.is_manifest("path"))) == [".env.prod", "x/go.mod"]
    assert paths(f.filter(extract.supported("path"))) == ["a/types.ts", "docs/a.ts", "src/types2.ts", "src/utils/x.ts"]
    assert [paths(x) for x in predicates.by_output(f.filter("path like 'docs%' or path = 'b.md'"), "docs")] == [["b.md"], ["docs/a.ts"]]
    packed = spark.createDataFrame([("m/a.ts",), ("m/b/c.ts",), ("mm/a.ts",), ("flat.ts",), ("flatter.ts",)], "path string")
    modules = spark.createDataFrame([("one", "m", ["x"]), ("two", "none", ["flat"]), ("three", "void", [])], "module string, path string, files array<string>")
    assert sorted(map(tuple, predicates.of_modules(packed, modules).collect())) == [("one", "m/a.ts"), ("one", "m/b/c.ts"), ("two", "flat.ts"), ("two", "flatter.ts")]


def test_round_views(spark):
    m = spark.createDataFrame([("core", "src/core", ["src/core/a.ts", "x.ts"])], "module string, path string, files array<string>")
    t = spark.createDataFrame([("src/core/a.test.ts", 1), ("tests/core-flow.ts", 2), ("tests/other.ts", 3)], "path string, tests int")
    assert sorted(r["path"] for r in rounds.module_tests(m, t).collect()) == ["src/core/a.test.ts", "tests/core-flow.ts"]
    assert [r["path"] for r in rounds.module_files(m, spark.createDataFrame([("x.ts",), ("y.ts",)], "path string")).collect()] == ["x.ts"]
    packed = spark.createDataFrame([("a/Dockerfile", 2, "full", "F" * 4000), ("b/Dockerfile", 1, "skip", ""), ("c/my.yml", 3, "full", "y")], "path string, rank int, tier string, content string")
    got = {r["file"]: r["content"] for r in rounds.config_contents(spark.createDataFrame([("a/Dockerfile",), ("Dockerfile",), ("y.yml",), ("zz",)], "file string"), packed).collect()}
    assert (len(got["a/Dockerfile"]), got["Dockerfile"], got["y.yml"], got["zz"]) == (3000, None, "y", None)
    r = spark.createDataFrame([(1, "success", 3, 1), (2, "degraded", 0, 0), (3, "skipped", 0, 0)], "round int, status string, validated int, corrected int")
    assert rounds.failure_line(rounds.failure_counts(r)).first()[0] == "AI analysis: 1/3 rounds complete (1 degraded), 3 claims validated, 1 corrected"
    saved = lambda a, b, s="done": rounds.parallel_savings(spark.createDataFrame([(5, s, a), (6, "done", b)], "round int, status string, ms long")).first()[0]
    assert (saved(5000, 3000), saved(9000, 2000), saved(5000, 3000, "cached")) == (3000, None, None)
    presets = spark.createDataFrame([("a", "m", False, 3.0, 15.0), ("b", "m", False, 1.0, 5.0), ("loc", "m", True, None, None), ("cur", "m", False, 9.0, 9.0)], "provider string, model string, local boolean, price_in double, price_out double")
    est = rounds.cost_estimates(F.lit(1_000_000), presets, "cur").orderBy("place").collect()
    assert [(x["provider"], round(x["cost"], 2)) for x in est] == [("cur", 10.8), ("b", 2.0), ("a", 6.0), ("loc", 0.0)]
    fields = spark.createDataFrame([('{"modules":["m",{"name":"n"},{"x":1}],"key_findings":["f"],"relationships":[{"from":"a","to":"b","type":"t"},{"from":"c"}],"openQuestions":["q"]}',), ("{}",)], "o string").select(rounds.round_fields("o").alias("r")).select("r.*").collect()
    assert tuple(fields[0]) == (["m", "n"], ["f"], ["a -> b (t)"], ["q"])
    assert tuple(fields[1]) == ([], [], [], [])
    cut = scoring.compress_context(spark.createDataFrame([(1, ["mod"], ["f1" * 30, "f2" * 30], ["r" * 40], ["q" * 40])], "round int, modules array<string>, findings array<string>, relationships array<string>, open_questions array<string>"), 25).first()
    assert (cut["open_questions"], cut["findings"], cut["relationships"], cut["modules"]) == ([], ["f1" * 30], [], [])


def test_snapshots_and_settings(spark, tmp_path):
    path = f"file://{tmp_path}/s.json"
    assert snapshots.read_json(spark, path) is None
    snapshots.write_json(spark, path, {"version": 1, "a": "ü"})
    snapshots.write_json(spark, path, {"version": 2, "a": "ü"})
    assert snapshots.read_json(spark, path, 2) == {"version": 2, "a": "ü"}
    assert snapshots.read_json(spark, path, 1) is None
    assert json.loads((tmp_path / "s.json").read_text()) == {"version": 2, "a": "ü"}
    (tmp_path / "bad.json").write_text("{")
    assert snapshots.read_json(spark, f"file://{tmp_path}/bad.json") is None
    assert snapshots.key_values(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")) == {"a": "1", "b": "2"}
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    snapshots.write_table(one, f"{tmp_path}/t", "k")
    snapshots.write_table(spark.createDataFrame([("a", 2)], "k string, v int"), f"{tmp_path}/t", "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 2), ("b", 1)]
    got = settings.settings("a: 1\nb: 2\nc: 3", {"X_B": "b", "X_C": "c"}, {"c": None, "d": 5}, {"a": 0, "e": 6}, env={"X_B": "env", "X_C": ""})
    assert got == {"a": 1, "b": "env", "c": 3, "d": 5, "e": 6}
    with pytest.raises(settings.SettingsError):
        settings.settings("a: [", {}, {}, {})
    with pytest.raises(settings.SettingsError, match="no a"):
        settings.settings("", {}, {}, {}, lambda s: ["no a"], {})
    changes = spark.createDataFrame([("a", "diff"), ("a", "staged"), ("b", "ignored")], "path string, state string")
    assert [r[0] for r in settings.changes_since(changes)[0].collect()] == ["a"]
    assert settings.changes_since(changes, shallow=True) == (None, "Shallow clone detected")
    assert (settings.decide(0, 3, 3), settings.decide(1, 3, 3), settings.decide(3, 3, 3), settings.decide(0, 0, 0)) == ("none", "some", "all", "all")
    docs = spark.createDataFrame([("r1", "a.md"), ("r2", "b.md"), ("r3", "c.md")], "renderer string, filename string")
    kept = settings.reused(docs, docs.filter("renderer = 'r1'"), docs.filter("filename != 'c.md'"))
    assert {r["renderer"]: r["reused"] for r in kept.collect()} == {"r1": False, "r2": True, "r3": False}
    assert [settings.exit_code(*x) for x in ((0, False), (2, False), (2, True))] == [0, 1, 2]
    tries = []

    def post(texts):
        if len(texts) == 2 and not tries:
            tries.append(1)
            raise OSError
        return [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(texts)))]

    rows = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "zzz")], "key string, content string").coalesce(1)
    assert sorted((r["key"], r["embedding"][0]) for r in settings.embedder(post, 2, 2, sleep=lambda s: None)(rows).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_catalog_and_site(spark):
    docs = spark.createDataFrame([("02-b", "B", "02-B.md", "---\ntitle: Bee & Co\n---\n# H\n\ntext *it* `c<d` [l](01-A.md#x)\n\n- a\n  - b\n- c\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```mermaid\ngraph\n```\n<!-- no -->\n<b>raw</b>\n\n> q"), ("01-a", "A", "01-A.md", "x")], "doc_id string, title string, source_file string, content string")
    c = snapshots.Catalog("x")
    c.add_documents(docs)
    c.add_analysis("tree", "Tree", spark.createDataFrame([(1, "a")], "n int, p string"))
    assert [e["uri"] for e in c.listed()] == ["x://analysis/tree", "x://docs/01-a", "x://docs/02-b"]
    assert c.read("x://docs/01-a")["text"] == "x"
    assert json.loads(c.read("x://analysis/tree")["text"]) == [{"n": 1, "p": "a"}]
    assert c.read("x://no")["available"][0] == "x://analysis/tree"
    assert c.page(0, 2)[1] == 2
    pages = {r["filename"]: r["html"] for r in site.site(docs).collect()}
    assert sorted(pages) == ["01-A.html", "02-B.html", "index.html"]
    assert "url=01-A.html" in pages["index.html"]
    b = pages["02-B.html"]
    for part in ("<title>Bee &amp; Co</title>", "<h1>H</h1>", "<em>it</em>", "<code>c&lt;d</code>", '<a href="01-A.html#x">l</a>', "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "<th>x</th>", "<td>2</td>", '<pre class="mermaid">graph</pre>', "&lt;b&gt;raw&lt;/b&gt;", "<blockquote><p>q</p></blockquote>", '<a href="01-A.html">A</a>'):
        assert part in b, part
    assert "no -->" not in b
    text, data = site.report("R", [("Files", spark.createDataFrame([("a|b", 1)], "path string, n int"), 5), ("None", spark.createDataFrame([], "x int"), 5)])
    assert "| a\\|b | 1 |" in text
    assert json.loads(data)["Files"] == [{"path": "a|b", "n": 1}]
    assert site.title_of("06-MY_MODULES.md") == "My Modules"


def test_files_are_read_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 64 << 20)
    try:
        rows = [(f"a{i}.py", None if i % 50 == 7 else f"def f{i}(): pass") for i in range(3 * extract.FILES + 5)] + [(None, "x")]
        got = extract.parse(spark.createDataFrame(rows, "path string, content string").coalesce(1)).collect()
        assert int(spark.conf.get(key)) <= extract.BATCH < 64 << 20
        assert [(r.path, r.ast and r.ast.functions[0].name) for r in got] == [(p, p and c and p[:-3].replace("a", "f")) for p, c in rows]
    finally:
        spark.conf.set(key, before)


def test_imports_are_resolved_in_tasks_by_their_number(spark):
    from factloom.operators import graph

    e = spark.createDataFrame([("a/x.ts", "./b"), ("a/x.ts", "./b"), ("a/y.ts", "./none")], "src string, specifier string")
    got = graph.resolve(e, spark.createDataFrame([("a/b.ts",), ("a/b/index.ts",)], "path string"), parts=7)
    assert "REPARTITION_BY_NUM, " in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 7)" in plan
    assert [tuple(r) for r in got.collect()] == [("a/x.ts", "./b", "a/b.ts")]
