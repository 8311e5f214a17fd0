"""Queries over source code made from the driver's documents: symbols, summaries, packing inputs, modules, rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import facts, incremental, predicates, reindex, retrieval, rounds, scoring, steps
from factloom.plans.catalog import NEAR8, _matches, load, query
from factloom.sources import settings
from factloom.streaming import sessions
from factloom.symbols import extract

NL, Q, DQ = "chr(10)", "chr(39)", "chr(34)"
#: A document's text inside a comment, and as a string of Python.
REMARK = "concat('/* ', replace(replace(text, '*/', '  '), '/*', '  '), ' */')"
QUOTED = "concat(repeat(chr(34), 3), replace(replace(text, chr(34), ' '), chr(92), ' '), ' ', repeat(chr(34), 3))"
LINES = "(length(text) - length(replace(text, chr(10), '')))"

TS = f"""concat('import {{ a', doc_id, ' as b }} from ', {Q}, './m', doc_id % 7, {Q}, ';', {NL}, {REMARK}, {NL}, {NL},
 'export async function f', doc_id, '(x: Map<string, number>, ...y: T', doc_id % 5, '[]): Promise<number> {{', {NL}, repeat(concat('  if (x) {{ /[(]/.test(', {Q}, ')', {Q}, ') }}', {NL}), CAST(doc_id % 4 AS INT)), '}}', {NL},
 'class H extends Z {{}}', {NL}, 'export class C', doc_id, '<T> extends B<T> implements I', doc_id % 3, ' {{ private z = 1; static async go(): Promise<{{ k: T }}> {{}} }}', {NL},
 'const hidden = 1', {NL}, 'export const K', doc_id, ' = ', doc_id, ', arrow = (a) => a', {NL}, 'export default f', doc_id, {NL})"""
PY = f"""concat('import os, a', doc_id, ' as z', {NL}, 'from ..p', doc_id % 7, ' import q as r, s', {NL}, 'T', doc_id, ' = ', {QUOTED}, {NL}, '@deco(', doc_id, ')', {NL},
 'async def f', doc_id, '(a, b: int = ', doc_id % 9, ', *c, d, **e) -> str:', {NL}, repeat(concat('    x = 1', {NL}), CAST(doc_id % 4 + 1 AS INT)),
 'class C', doc_id, '(B', doc_id % 3, ', metaclass=M):', {NL}, '    attr: int = 1', {NL}, '    def __init__(self, v):', {NL}, '        self._v = v', {NL}, '    def __hide(self): pass', {NL}, 'MAX_', doc_id, ' = ', doc_id, {NL}, 'lower = 2', {NL})"""
GO = f"""concat('package p', {NL}, 'import (', {NL}, ' m', doc_id % 5, ' ', {DQ}, 'a/b', doc_id, {DQ}, {NL}, ' _ ', {DQ}, 'x/y', {DQ}, {NL}, ')', {NL}, {REMARK}, {NL}, {NL},
 'type S', doc_id, ' struct {{', {NL}, ' A, b int', {NL}, ' *Base', {NL}, '}}', {NL}, 'func (s *S', doc_id, ') Do(x, y int) error {{', {NL}, repeat(concat(' go()', {NL}), CAST(doc_id % 4 AS INT)), '}}', {NL},
 'func low', doc_id, '() {{}}', {NL}, 'func Up', doc_id, '[T any](v ...T) (int, error) {{ return 0, nil }}', {NL}, 'const (', {NL}, ' K', doc_id, ' = iota', {NL}, ' k', {NL}, ')', {NL})"""
RUST = f"""concat('use std::{{fmt, io::{{self, Read as R', doc_id % 5, '}}}};', {NL}, {REMARK}, {NL}, {NL}, 'pub struct S', doc_id, '<T> {{ pub a: T, b: Vec<u8> }}', {NL}, 'pub enum E', doc_id, ' {{ A, B(i32) }}', {NL},
 'impl E', doc_id, ' {{ pub fn new(x: u8) -> Self {{ loop {{}} }} }}', {NL}, 'impl Tr for E', doc_id, ' {{}}', {NL}, 'pub fn f', doc_id, '(s: &', {Q}, 'static str) -> char {{', {NL}, repeat(concat('  g(', {Q}, '}}', {Q}, ');', {NL}), CAST(doc_id % 4 AS INT)), '}}', {NL},
 'fn low() {{}}', {NL}, 'pub const K', doc_id, ': usize = ', doc_id, ';', {NL})"""
JAVA = f"""concat('import java.util.L', doc_id % 5, ';', {NL}, '/** ', replace(replace(replace(text, '*/', '  '), '/*', '  '), {NL}, ' '), ' */', {NL}, 'public class C', doc_id, ' extends B', doc_id % 3, ' {{', {NL}, '  private int m', doc_id, '(String a, Map<K, V> b) {{', {NL}, '  }}', {NL}, '  public void go() {{ }}', {NL}, '}}', {NL})"""


def source(spark, sf, code: str, ending: str):
    """(doc_id, path, content, ast) of files made from documents."""
    d = load(spark, sf, "documents").select("doc_id", F.expr(code).alias("content"), F.concat(F.lit("d/f"), F.col("doc_id").cast("string"), F.lit(ending)).alias("path"))
    return extract.parse(d).drop("warning")


def digest(files):
    """What a file declares, as text."""
    join = lambda c, f: F.array_join(F.transform(f"ast.{c}", f), " ")
    typed = lambda p: F.concat(p["name"], F.when(p["is_rest"], "*").otherwise(""), F.coalesce(F.concat(F.lit(":"), p["type"]), F.lit("")))
    span = lambda s: F.concat(s["name"], F.lit("@"), (s["end_line"] - s["line"]).cast("string"), F.lit("+"), (s["line"]).cast("string"))
    return files.select(
        "doc_id", F.col("ast.line_count").alias("line_count"), join("functions", span).alias("functions"), join("functions", lambda f: F.concat(F.lit("("), F.array_join(F.transform(f["parameters"], typed), ","), F.lit(")"), F.coalesce(f["return_type"], F.lit("")))).alias("signatures"),
        join("classes", span).alias("classes"), join("classes", lambda c: F.concat(F.array_join(c["extends"], ","), F.lit("|"), F.array_join(c["implements"], ","), F.lit("|"), F.array_join(F.transform(c["fields"], lambda f: F.concat(f["name"], F.lit(":"), f["visibility"])), ","), F.lit("|"), F.array_join(F.transform(c["methods"], lambda m: F.concat(m["name"], F.lit(":"), m["visibility"])), ","))).alias("members"),
        join("imports", lambda i: F.concat(i["source"], F.lit("="), F.array_join(F.transform(i["specifiers"], lambda s: F.concat(s["name"], F.coalesce(F.concat(F.lit(">"), s["alias"]), F.lit("")))), ","))).alias("imports"),
        join("exports", lambda e: F.concat(e["name"], F.lit(":"), e["kind"])).alias("exports"), join("constants", lambda c: F.concat(c["name"], F.lit("="), F.length(F.coalesce(c["value"], F.lit(""))).cast("string"))).alias("constants"), F.size("ast.parse_errors").alias("errors"),
    )


def expected(**columns) -> str:
    return "SELECT doc_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + ", 0 AS errors FROM (SELECT *, " + LINES + " AS n, doc_id % 4 AS k FROM documents)"


@query(expected(
    line_count="CAST(n + k + 11 AS INT)", functions="concat('f', doc_id, '@', k + 1, '+', n + 4, ' arrow@0+', n + k + 9)", signatures="concat('(x:Map<string, number>,...y*:T', doc_id % 5, '[])Promise<number> (a)')",
    classes="concat('H@0+', n + k + 6, ' C', doc_id, '@0+', n + k + 7)", members="concat('Z||| B|I', doc_id % 3, '|z:private|go:public')", imports="concat('./m', doc_id % 7, '=a', doc_id, '>b')",
    exports="concat('f', doc_id, ':function C', doc_id, ':class K', doc_id, ':variable arrow:function default:default')", constants="concat('K', doc_id, '=', length(doc_id::VARCHAR))",
))
def symbols_typescript(spark, sf):
    return digest(source(spark, sf, TS, ".ts"))


@query(expected(
    line_count="CAST(n + k + 14 AS INT)", functions="concat('f', doc_id, '@', k + 1, '+', n + 5)", signatures="'(a,b:int,c*,d,e*:dict)str'", classes="concat('C', doc_id, '@4+', n + k + 7)",
    members="concat('B', doc_id % 3, '||attr:public,_v:protected|__init__:public,__hide:private')", imports="concat('os=os,a', doc_id, '>z ..p', doc_id % 7, '=q>r,s')",
    exports="concat('T', doc_id, ':variable f', doc_id, ':function C', doc_id, ':class MAX_', doc_id, ':variable')", constants="concat('T', doc_id, '=', least(100, length(text) + 7), ' MAX_', doc_id, '=', length(doc_id::VARCHAR))",
))
def symbols_python(spark, sf):
    return digest(source(spark, sf, PY, ".py"))


@query(expected(
    line_count="CAST(n + k + 20 AS INT)", functions="concat('low', doc_id, '@0+', n + k + 14, ' Up', doc_id, '@0+', n + k + 15)", signatures="'() (v*:...T)(int, error)'", classes="concat('S', doc_id, '@3+', n + 8)",
    members="'Base||A:public,b:private|Do:public'", imports="concat('a/b', doc_id, '=b', doc_id, '>m', doc_id % 5, ' x/y=_')", exports="concat('Up', doc_id, ':function S', doc_id, ':class K', doc_id, ':variable')", constants="concat('K', doc_id, '=4')",
))
def symbols_go(spark, sf):
    return digest(source(spark, sf, GO, ".go"))


@query(expected(
    line_count="CAST(n + k + 12 AS INT)", functions="concat('f', doc_id, '@', k + 1, '+', n + 8, ' low@0+', n + k + 10)", signatures="concat('(s:&', chr(39), 'static str)char ()')", classes="concat('S', doc_id, '@0+', n + 4, ' E', doc_id, '@0+', n + 5)",
    members="'||a:public,b:private| |Tr|A:public,B:public|new:public'", imports="concat('std::=fmt std::io=self std::io::=Read>R', doc_id % 5)", exports="concat('E', doc_id, ':enum f', doc_id, ':function S', doc_id, ':class K', doc_id, ':variable')",
    constants="concat('K', doc_id, '=', length(doc_id::VARCHAR))",
))
def symbols_rust(spark, sf):
    return digest(source(spark, sf, RUST, ".rs"))


@query(expected(
    line_count="8", functions="concat('m', doc_id, '@0+4 go@0+6')", signatures="'(a:String,b:Map<K, V>) ()'", classes="concat('C', doc_id, '@0+3')", members="concat('B', doc_id % 3, '|||')", imports="concat('java.util.L', doc_id % 5, '=L', doc_id % 5)",
    exports="concat('go:function C', doc_id, ':class')", constants="''",
))
def symbols_by_line(spark, sf):
    return digest(source(spark, sf, JAVA, ".java"))


ALL = f"CASE doc_id % 5 WHEN 0 THEN {TS} WHEN 1 THEN {PY} WHEN 2 THEN {GO} WHEN 3 THEN {RUST} ELSE {JAVA} END"
ENDING = "element_at(array('.ts', '.py', '.go', '.rs', '.java'), cast(doc_id % 5 + 1 as int))"


def _mixed(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.expr(ALL).alias("content"), F.concat(F.lit("d/f"), F.col("doc_id").cast("string"), F.expr(ENDING)).alias("path"))
    return extract.parse(d)


@query("""WITH c AS (SELECT doc_id % 5 AS l, count(*) AS files FROM documents GROUP BY 1) SELECT CASE l WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' ELSE 'java' END AS language, files,
 CAST(files * CASE l WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS functions, CAST(files * CASE l WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS classes, CAST(files * CASE l WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 2 END AS BIGINT) AS exports,
 CAST(files * CASE l WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS BIGINT) AS imports FROM c""")
def ast_totals(spark, sf):
    return extract.totals(_mixed(spark, sf))


@query("""SELECT doc_id, sha256(concat('// FILE: d/f', doc_id, '.ts (', n + doc_id % 4 + 11, ' lines)', chr(10), 'export async function f', doc_id, '(x: Map<string, number>, ...y: T', doc_id % 5, '[]): Promise<number>', chr(10), 'export function arrow(a)', chr(10),
 'export class C', doc_id, ' { go(): Promise<{ k: T }> }', chr(10), 'export const K', doc_id, chr(10), '// 1 imports from: ./m', doc_id % 7)) AS summary FROM (SELECT *, length(text) - length(replace(text, chr(10), '')) AS n FROM documents)""")
def signature_summaries(spark, sf):
    return source(spark, sf, TS, ".ts").select("doc_id", F.sha2(scoring.signature_summary(), 256).alias("summary"))


@query("SELECT doc_id, concat('Export: f', doc_id, ' ', doc_id % 4 + 2, ';Export: arrow 1;Export: C', doc_id, ' 1') AS sections FROM documents")
def oversized_sections(spark, sf):
    listed = F.transform(scoring.sections(), lambda s: F.concat(s["label"], F.lit(" "), F.size(F.split(s["content"], "\n")).cast("string")))
    return source(spark, sf, TS, ".ts").select("doc_id", F.array_join(listed, ";").alias("sections"))


@query("SELECT concat('d/f', doc_id, '.ts') AS path, unnest([concat('functions:f', doc_id, ':'), 'functions:arrow:', concat('classes:C', doc_id, ':go')]) AS symbol FROM documents")
def exported_symbols(spark, sf):
    s = predicates.exported_symbols(source(spark, sf, TS, ".ts").select("path", "ast"))
    return s.select("path", F.concat_ws(":", "kind", "name", F.array_join("methods", ",")).alias("symbol"))


#: Rounds whose lists are words of documents, cut to 60 tokens.
WORDS = "string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')"


@query(f"""WITH w AS (SELECT doc_id, list_filter({WORDS}, lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, CAST(ceil(len(w) / 4.0) AS BIGINT) AS q FROM w),
c AS (SELECT doc_id, (i - 1) // q AS l, sum(length(x) + CASE WHEN (i - 1) // q = 1 THEN 3 ELSE 2 END) OVER (PARTITION BY doc_id, (i - 1) // q ORDER BY i) + [8, 10, 14, 15][(i - 1) // q + 1] AS s FROM u),
d AS (SELECT w.doc_id, 17 + length(w.doc_id::VARCHAR) AS h, coalesce(max(s) FILTER (l = 0), 0) AS m, coalesce(max(s) FILTER (l = 1), 0) AS f, coalesce(max(s) FILTER (l = 2), 0) AS r, count(*) FILTER (l = 1) AS nf FROM w LEFT JOIN c ON c.doc_id = w.doc_id GROUP BY w.doc_id),
q1 AS (SELECT d.*, count(s) AS kq, coalesce(max(s), 0) AS oq FROM d LEFT JOIN c ON c.doc_id = d.doc_id AND l = 3 AND s + h + m + f + r <= 120 GROUP BY ALL),
q2 AS (SELECT q1.*, greatest(count(s) FILTER (s + h + m + r + oq <= 120), max(least(1, nf))) AS kf, coalesce(max(s) FILTER (s + h + m + r + oq <= 120), min(s), 0) AS ff FROM q1 LEFT JOIN c ON c.doc_id = q1.doc_id AND l = 1 GROUP BY ALL),
q3 AS (SELECT q2.*, count(s) AS kr, coalesce(max(s), 0) AS orr FROM q2 LEFT JOIN c ON c.doc_id = q2.doc_id AND l = 2 AND s + h + m + ff + oq <= 120 GROUP BY ALL),
q4 AS (SELECT q3.*, count(s) AS km, coalesce(max(s), 0) AS om FROM q3 LEFT JOIN c ON c.doc_id = q3.doc_id AND l = 0 AND s + h + ff + orr + oq <= 120 GROUP BY ALL)
SELECT doc_id, km AS modules, kf AS findings, kr AS relationships, kq AS questions, CAST(ceil((h + om + ff + orr + oq) / 4.0) AS BIGINT) AS tokens FROM q4""")
def compressed_contexts(spark, sf):
    w = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda x: x != "")
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("round"), w.alias("w")).withColumn("q", F.ceil(F.size("w") / 4).cast("int"))
    d = d.select("round", *(F.slice("w", F.col("q") * i + 1, F.col("q")).alias(c) for i, c in enumerate(("modules", "findings", "relationships", "open_questions"))))
    return scoring.compress_context(d, 30).select(F.col("round").alias("doc_id"), F.size("modules").cast("long").alias("modules"), F.size("findings").cast("long").alias("findings"), F.size("relationships").cast("long").alias("relationships"), F.size("open_questions").cast("long").alias("questions"), "tokens")


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS step FROM nation WHERE n_nationkey % 9 = 4), e AS (SELECT n_nationkey AS step, n_nationkey // 2 AS needs FROM nation WHERE n_nationkey > 0),
r AS (SELECT e.step FROM e JOIN f ON e.needs = f.step UNION SELECT e.step FROM e JOIN r ON e.needs = r.step) SELECT n_nationkey AS step, CASE WHEN n_nationkey IN (SELECT step FROM r) THEN 'skipped' WHEN n_nationkey % 9 = 4 THEN 'failed' ELSE 'completed' END AS state FROM nation""")
def step_states(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("step"))
    return steps.states(n, n.filter("step > 0").withColumn("needs", F.floor(F.col("step") / 2)), n.filter("step % 9 = 4"))


@query("SELECT n_name AS module, concat('m', n_nationkey, '/s', s_suppkey) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 2 UNION ALL SELECT n_name, concat('m', s_nationkey, '/s', s_suppkey) FROM supplier JOIN nation ON s_nationkey = (n_nationkey + 1) % 25 AND starts_with(concat('m', s_nationkey, '/s', s_suppkey), concat('m', (n_nationkey + 1) % 25, '/s1')) WHERE n_nationkey % 3 = 2")
def files_of_modules(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_name").alias("module"), F.col("n_nationkey").alias("k"))
    modules = n.select("module", F.when(F.col("k") % 3 == 2, F.concat(F.lit("none"), "k")).otherwise(F.concat(F.lit("m"), "k")).alias("path"), F.array(F.concat(F.lit("m"), ((F.col("k") + 1) % 25).cast("string"), F.lit("/s1"))).alias("files"))
    return predicates.of_modules(load(spark, sf, "supplier").select(F.concat(F.lit("m"), "s_nationkey", F.lit("/s"), "s_suppkey").alias("path")), modules)


@query(f"""WITH {NEAR8} SELECT query_id, rank::INT AS rank, relevance, label::VARCHAR AS source, concat('S', vec_id % 2) AS section, CASE WHEN rank <= 3 THEN concat('content ', vec_id) END AS content FROM m""")
def tool_results(spark, sf):
    m = _matches(spark, sf).withColumns({"content_preview": F.lit(""), "doc_type": F.lit("t"), "content": F.concat(F.lit("content "), F.col("vec_id").cast("string"))})
    return retrieval.tool_results(m, ("query_id",)).select("query_id", "rank", "relevance", "source", "section", "content")


@query(f"""WITH {NEAR8}, c AS (SELECT query_id, list(concat('[', rank, ']', chr(10), 'source_file: ', label, chr(10), 'section_path: S', vec_id % 2, chr(10), 'chunk_index: ', vec_id % 3, chr(10), 'relevance: ', printf('%.2f', relevance), '%', chr(10), 'content:', chr(10), 'body ', vec_id, chr(10)) ORDER BY rank) AS parts FROM m GROUP BY 1)
SELECT query_id, sha256(trim(array_to_string(parts, chr(10)), concat(' ', chr(10)))) AS context FROM c""")
def prompt_contexts(spark, sf):
    m = _matches(spark, sf).withColumn("content", F.concat(F.lit("  body "), F.col("vec_id").cast("string"), F.lit("\n")))
    return retrieval.prompt_context(m, ("query_id",)).select("query_id", F.sha2("context", 256).alias("context"))


@query(f"""WITH {NEAR8}, a AS (SELECT query_id, max(relevance) AS top, list_sort(list(relevance), 'DESC')[2] AS second, count(DISTINCT label) AS sources, count(DISTINCT (label, vec_id % 2, vec_id % 3)) AS cited FROM m GROUP BY 1)
SELECT query_id, CASE WHEN top < 58 OR second < 45 OR sources < 2 OR top - second >= 18 AND second > 0 THEN 'clarification' ELSE 'answer' END AS kind, cited::INT AS cited FROM a""")
def qa_answers(spark, sf):
    m = _matches(spark, sf).withColumn("content", F.col("vec_id").cast("string"))
    return retrieval.answers(m, ("query_id",)).select("query_id", "kind", F.size("citations").alias("cited"))


@query("""WITH d AS (SELECT doc_id::VARCHAR AS doc_id, doc_id AS id, source, text FROM documents WHERE regexp_matches(text, '\\S')),
n AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ELSE 'old' END AS content, CASE WHEN source IN ('src1', 'src2') THEN 2 ELSE 1 END AS dims FROM d)
SELECT * FROM n UNION ALL SELECT 'gone', 'old', 1""")
def reindexed(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("doc_type"), F.col("source").alias("source_file"), F.col("text").alias("content"))
    known = docs.filter("source_file != 'src1'").select("doc_id", F.when(F.col("source_file") == "src2", "stale").otherwise(T.document_fingerprint("source_file", "content")).alias("fingerprint"), F.lit(1).cast("long").alias("chunk_count"))
    empty = reindex.new(spark, "m", 2)
    row = lambda ids: ids.select("doc_id", *(F.lit(None).cast(dict(empty.chunks.dtypes)[c]).alias(c) for c in empty.chunks.columns[1:-2]), F.lit("old").alias("content"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    index = reindex.Index(row(known.unionByName(spark.createDataFrame([("gone", "", 0)], "doc_id string, fingerprint string, chunk_count long"))), known, empty.meta)
    vectors = lambda rows: rows.select("key", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    after, _ = reindex.reindex(docs, index, vectors, "m", 2)
    return after.chunks.select("doc_id", F.when(F.size("embedding") == 2, F.sha2("content", 256)).otherwise(F.col("content")).alias("content"), F.size("embedding").alias("dims"))


@query("SELECT source, sha256(string_agg(concat(doc_id, ':', sha256(text)), chr(10) ORDER BY doc_id::VARCHAR)) AS fingerprint FROM documents GROUP BY 1")
def repository_print(spark, sf):
    d = load(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return settings.repository_print(d, "source")


@query("WITH p AS (SELECT conv_id, list(concat(role, turn) ORDER BY turn) AS p FROM conversations GROUP BY 1) SELECT conv_id AS name, i - 1 AS place, p[i] AS \"from\", p[i + 1] AS \"to\" FROM p, unnest(range(1, len(p))) t(i)")
def flow_neighbours(spark, sf):
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("path"))
    return rounds.adjacent(c.select(F.col("conv_id").alias("name"), "path")).withColumn("place", F.col("place").cast("long"))


@query("WITH t AS (SELECT n_name AS name, n_nationkey AS seq FROM nation ORDER BY 2 LIMIT 15), e AS (SELECT a.name AS a, b.name AS b, n.n_nationkey AS seq FROM nation n JOIN t a ON a.seq = n.n_nationkey JOIN t b ON b.seq = (n.n_nationkey * 7 + 3) % 25), l AS (SELECT 0 AS p, seq, concat('  ', replace(name, ' ', '_'), '[\"', name, '\"]') AS line FROM t UNION ALL SELECT 1, seq, concat('  ', replace(a, ' ', '_'), ' --> ', replace(b, ' ', '_')) FROM e) SELECT concat('```mermaid', chr(10), 'graph LR', chr(10), string_agg(line, chr(10) ORDER BY p, seq), chr(10), '```') AS diagram FROM l")
def module_diagram(spark, sf):
    n = load(spark, sf, "nation")
    other = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("to"))
    edges = n.join(other, F.expr("k = (n_nationkey * 7 + 3) % 25")).select(F.col("n_name").alias("from"), "to", F.col("n_nationkey").alias("seq"))
    return rounds.diagram(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("seq")), edges, rounds.MODULE_NODES, "graph LR")


@query("WITH t AS (SELECT concat('src', event_id % 14, '/f') AS path, event_type AS text, event_id AS seq, concat('src', event_id % 14) AS folder FROM events), g AS (SELECT folder, min(seq) AS first, count(*) AS remarks FROM t GROUP BY 1 ORDER BY 2 LIMIT 10), k AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS k FROM t QUALIFY k <= 5) SELECT folder, g.first, g.remarks, string_agg(text, ',' ORDER BY seq) AS items FROM g JOIN k USING (folder) GROUP BY ALL")
def remarks_by_folder(spark, sf):
    e = load(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 14).cast("string"), F.lit("/f")).alias("path"), F.col("event_type").alias("text"), F.col("event_id").alias("seq"))
    return rounds.remarks_by_folder(e).withColumn("items", F.array_join("items", ",")).drop("remarks_listed")


@query("SELECT o_custkey AS path, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS production, count(*) FILTER (o_orderstatus = 'O') AS development, count(*) FILTER (o_orderstatus = 'P') AS peer, CAST(0 AS BIGINT) AS optional FROM orders GROUP BY 1")
def dependency_counts(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "production").when(F.col("o_orderstatus") == "O", "development").otherwise("peer")
    return rounds.dependency_counts(load(spark, sf, "orders").select(F.col("o_custkey").alias("path"), kind.alias("type")))


@query("SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, CAST(ceil(sum(strlen(text)) / 4.0) AS BIGINT) AS tokens FROM documents")
def repository_tokens(spark, sf):
    return rounds.repository_tokens(load(spark, sf, "documents").select(F.octet_length("text").alias("size")))


@query("SELECT turn AS round, sum(sum(length(text))) OVER (ORDER BY turn)::BIGINT AS total FROM conversations GROUP BY 1")
def cumulative_tokens(spark, sf):
    r = load(spark, sf, "conversations").groupBy(F.col("turn").alias("round")).agg(F.lit("done").alias("status"), F.sum(F.length("text")).alias("tokens"), F.lit(0).alias("streaming"))
    return rounds.cumulative_tokens(r).select("round", "total")


@query("""WITH j AS (SELECT user_id % 50 AS t, min(event_id) AS active FROM events WHERE event_type = 'click' GROUP BY 1), r AS (SELECT event_id, user_id % 50 AS t FROM events WHERE event_type <> 'click'), f AS (SELECT t, min(event_id) AS first FROM r GROUP BY 1)
SELECT event_id AS request, coalesce(active, first) AS job, active IS NOT NULL OR event_id <> first AS joined FROM r JOIN f USING (t) LEFT JOIN j USING (t)""")
def joined_jobs(spark, sf):
    e = load(spark, sf, "events").withColumn("target", F.concat(F.lit("  Full "), (F.col("user_id") % 50).cast("string")))
    jobs = e.filter("event_type = 'click'").select(F.col("event_id").alias("job"), "target", F.lit("running").alias("state"))
    return sessions.join_in_flight(e.filter("event_type != 'click'").select(F.col("event_id").alias("request"), "target", F.col("event_id").alias("seq")), jobs).drop("key")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'not-generated' WHEN o_custkey % 3 = 0 THEN 'complete' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'complete' WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'partial' ELSE 'static-only' END AS status FROM orders")
def document_states(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2))).alias("req"), F.array(F.when(F.col("o_orderkey") % 2 == 0, 1), F.when(F.col("o_orderkey") % 3 == 0, 2)).alias("has"), (F.col("o_custkey") % 4 != 0).alias("made"))
    return o.select("o_orderkey", rounds.document_status("req", "has", "made").alias("status"))


@query("SELECT event_id AS seq, event_type FROM events ORDER BY event_id LIMIT 100")
def recent_commits(spark, sf):
    return facts.recent(load(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type"))


@query("SELECT concat('f', user_id) AS path, count(*) AS todos FROM events GROUP BY 1")
def remark_counts(spark, sf):
    return facts.remark_counts(load(spark, sf, "events").select(F.concat(F.lit("f"), "user_id").alias("path")))


@query("WITH o AS (SELECT DISTINCT unnest([o_custkey % 4 + 3, o_orderkey % 3 + 9]) AS r FROM orders) SELECT r AS round FROM o UNION SELECT n_nationkey // 3 FROM nation JOIN o ON n_nationkey = r WHERE n_nationkey > 0")
def rounds_needed(spark, sf):
    docs = load(spark, sf, "orders").select(F.array((F.col("o_custkey") % 4 + 3).cast("long"), (F.col("o_orderkey") % 3 + 9).cast("long")).alias("rounds"))
    deps = load(spark, sf, "nation").filter("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("round"), F.floor(F.col("n_nationkey") / 3).alias("needs"))
    return incremental.rounds_needed(docs, deps)


@query("SELECT CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS input, round(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) * CASE role WHEN 'user' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END / 1e6), 6) AS cost FROM conversations")
def usage_totals(spark, sf):
    t = T.estimate_tokens("text")
    u = load(spark, sf, "conversations").select(F.col("role").alias("model"), t.alias("input"), F.lit(0).alias("output"), F.lit(0).alias("cache_read"), F.lit(0).alias("cache_write"))
    costs = incremental.usage_cost(u, spark.createDataFrame([("user", 3.0, 15.0), ("default", 1.0, 5.0)], "model string, price_in double, price_out double"))
    return incremental.usage_totals(costs).select("input", F.round("cost", 6).alias("cost"))
