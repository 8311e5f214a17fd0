"""Queries of streams with keyed state, graphs by frontier, indexes of globs, names and chunks, and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import briefs, graph, incremental, pruned, rounds
from factloom.operators.written import Work
from factloom.plans.catalog import PATHS, SQL, load, query
from factloom.sources import payloads
from factloom.streaming import stateful

#: Moves of a job for each user: what happened as a state.
STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END"
MOVES_SQL = f"""WITH m AS (SELECT user_id AS job_id, event_id AS seq, {STATE} AS state FROM events),
q AS (SELECT *, min(CASE WHEN state = 'queued' THEN seq END) OVER (PARTITION BY job_id) AS q FROM m),
r AS (SELECT *, min(CASE WHEN state = 'running' AND seq > q THEN seq END) OVER (PARTITION BY job_id) AS r FROM q),
o AS (SELECT *, min(CASE WHEN state IN ('completed', 'failed') AND seq > r THEN seq END) OVER (PARTITION BY job_id) AS o FROM r),
w AS (SELECT *, max(CASE WHEN seq = o THEN state END) OVER (PARTITION BY job_id) AS ended FROM o)
SELECT job_id, seq, state, CASE WHEN seq > o THEN ended WHEN seq > r THEN 'running' WHEN seq > q THEN 'queued' END AS was, coalesce(seq IN (q, r, o), false) AS ok FROM w"""


def _moves(events):
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATE).alias("state"))


@query(MOVES_SQL)
def job_moves(spark, sf):
    return stateful.job_moves(_moves(load(spark, sf, "events")))


def _streamed(spark, sf, name, run, side=None):
    """What a stream over a table's files gives until it has read them all. A table may be one file or a folder, which a stream
    reads alike if its path is a pattern."""
    source = load(spark, sf, name)
    root = Work(spark, "stream").root
    stateful.run_once(run(spark.readStream.schema(source.schema).parquet(f"{sf}/{name}.parque[t]")), f"{root}/out", f"{root}/checkpoint", side)
    return spark.read.parquet(f"{root}/out/*/batch=*")


@query(MOVES_SQL)
def stream_job_moves(spark, sf):
    return _streamed(spark, sf, "events", lambda e: stateful.job_log(_moves(e)), "ok")


IN_FLIGHT_SQL = """WITH l AS (SELECT concat('u', user_id) AS target, event_id AS seq, event_type = 'purchase' AS over FROM events),
t AS (SELECT *, coalesce(sum(over::INT) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM l),
j AS (SELECT *, min(CASE WHEN NOT over THEN seq END) OVER (PARTITION BY target, turn) AS first, count(CASE WHEN NOT over THEN seq END) OVER (PARTITION BY target, turn) AS served FROM t)
SELECT target, seq, CASE WHEN NOT over THEN seq::VARCHAR END AS request, first::VARCHAR AS job, NOT over AND seq > first AS joined, CASE WHEN over THEN served ELSE 0 END AS served FROM j WHERE served > 0"""


def _log(events):
    over = F.col("event_type") == "purchase"
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("target"), F.col("event_id").alias("seq"), F.when(~over, F.col("event_id").cast("string")).alias("request"), F.when(over, "completed").alias("state"))


def _whole(jobs):
    return jobs.withColumns({"joined": F.coalesce("joined", F.lit(False)), "served": F.coalesce("served", F.lit(0))})


@query(IN_FLIGHT_SQL)
def jobs_in_flight(spark, sf):
    return _whole(stateful.in_flight_jobs(_log(load(spark, sf, "events"))))


@query(IN_FLIGHT_SQL)
def stream_jobs_in_flight(spark, sf):
    return _whole(_streamed(spark, sf, "events", lambda e: stateful.in_flight(_log(e))))


#: Orders as steps: most need an earlier order, some a later one, so that there are cycles.
NEEDS = "SELECT o_orderkey AS b, CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 1 ELSE o_orderkey // 7 END AS a FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 2 = 0 UNION SELECT o_orderkey, o_orderkey - 1 FROM orders WHERE o_orderkey % 97 = 6"


def _orders(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    e = o.filter("o_orderkey > 0").selectExpr("o_orderkey AS b", "CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 1 ELSE o_orderkey div 7 END AS a")
    e = e.unionByName(o.filter("o_orderkey > 0 and o_orderkey % 2 = 0").selectExpr("o_orderkey AS b", "o_orderkey div 3 AS a")).unionByName(o.filter("o_orderkey % 97 = 6").selectExpr("o_orderkey AS b", "o_orderkey - 1 AS a"))
    return o.select(F.col("o_orderkey").alias("node")), e.distinct()


LAYERS_SQL = f"""WITH RECURSIVE n AS (SELECT o_orderkey AS node FROM orders), e AS (SELECT DISTINCT a, b FROM ({NEEDS}) WHERE a IN (SELECT node FROM n)),
bad AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 97 IN (5, 6) AND (CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 1 ELSE o_orderkey - 1 END) IN (SELECT node FROM n) UNION SELECT e.b FROM bad JOIN e ON e.a = bad.node),
p AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT node FROM bad) UNION SELECT e.b, p.layer + 1 FROM p JOIN e ON e.a = p.node WHERE e.b NOT IN (SELECT node FROM bad)),
l AS (SELECT node, max(layer) AS layer FROM p GROUP BY 1)
SELECT n.node, coalesce(l.layer, -1) AS layer FROM n LEFT JOIN l ON l.node = n.node"""


@query(LAYERS_SQL)
def step_layers(spark, sf):
    return graph.layers(*_orders(spark, sf)).withColumn("layer", F.coalesce("layer", F.lit(-1)))


@query(f"WITH RECURSIVE n AS (SELECT o_orderkey AS node FROM orders), e AS (SELECT DISTINCT a, b FROM ({NEEDS}) WHERE a IN (SELECT node FROM n)), bad AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 97 IN (5, 6) AND (CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 1 ELSE o_orderkey - 1 END) IN (SELECT node FROM n) UNION SELECT e.b FROM bad JOIN e ON e.a = bad.node) SELECT node FROM bad")
def step_cycles(spark, sf):
    return graph.layers(*_orders(spark, sf)).filter("layer is null").select("node")


@query(f"WITH RECURSIVE n AS (SELECT o_orderkey AS node FROM orders), e AS (SELECT DISTINCT a, b FROM ({NEEDS}) WHERE a IN (SELECT node FROM n)), r AS (SELECT o_orderkey AS node, 0 AS hops FROM orders WHERE o_orderstatus = 'P' UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 40) SELECT node, min(hops) AS hops FROM r GROUP BY 1")
def steps_behind(spark, sf):
    nodes, edges = _orders(spark, sf)
    return graph.reach(edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi"), load(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node")))


#: A glob for each page: files of its folder, files anywhere below its host that end like it, files of its name in any folder.
GLOB = "CASE page_id % 3 WHEN 0 THEN concat(regexp_replace(path, '[^/]*$', ''), '*') WHEN 1 THEN concat(regexp_replace(path, '/.*$', ''), '/**/*', right(path, 2)) ELSE concat('**/', regexp_replace(path, '^.*/', '')) END"


@query(f"""WITH p AS (SELECT page_id, {PATHS} AS path FROM pages),
g AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('^', replace(regexp_replace(path, '[^/]*$', ''), '.', '\\.'), '[^/]*$') WHEN 1 THEN concat('^', replace(regexp_replace(path, '/.*$', ''), '.', '\\.'), '/(?:[^/]+/)*[^/]*', replace(right(path, 2), '.', '\\.'), '$') ELSE concat('^(?:[^/]+/)*', replace(regexp_replace(path, '^.*/', ''), '.', '\\.'), '$') END AS rx FROM p)
SELECT DISTINCT g.page_id::VARCHAR AS name, p.path FROM g JOIN p ON regexp_matches(p.path, g.rx)""")
def glob_matches(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.expr(PATHS).alias("path"))
    return incremental.match_globs(p.select(F.col("page_id").cast("string").alias("name"), F.expr(GLOB).alias("glob")), p)


@query(SQL["knn_batch"])
def knn_pruned(spark, sf):
    e = load(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near, _ = pruned.knn_pruned(e, q, 5, 64, "query_id", "vec_id")
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


HOST = "regexp_extract(url, '^https?://(?:[a-z]+[.])?([a-z-]+)[.]example', 1)"


@query(f"WITH m AS (SELECT DISTINCT left({HOST}, 4) AS module FROM pages WHERE {HOST} <> '') SELECT DISTINCT module, page_id, url AS path FROM m JOIN pages ON contains(url, module)")
def names_in_paths(spark, sf):
    p = load(spark, sf, "pages")
    m = p.select(F.left(F.expr(HOST), F.lit(4)).alias("module")).filter("module != ''").distinct().select("module", F.lit("none").alias("path"), F.array(F.lit("x")).alias("files"))
    return rounds.module_tests(m, p.select("page_id", F.col("url").alias("path"))).select("module", "page_id", "path")


@query(f"WITH p AS (SELECT page_id, {PATHS} AS path, html FROM pages), c AS (SELECT DISTINCT right(path, 6) AS file FROM p), f AS (SELECT file, page_id, html, row_number() OVER (PARTITION BY file ORDER BY page_id) AS k FROM c JOIN p ON ends_with(path, file)) SELECT file, CASE WHEN page_id % 4 <> 0 THEN sha256(left(html, 3000)) END AS content FROM f WHERE k = 1")
def config_files(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.expr(PATHS).alias("path"), "html")
    packed = p.select("path", F.col("page_id").alias("rank"), F.when(F.col("page_id") % 4 == 0, "skip").otherwise("full").alias("tier"), F.col("html").alias("content"))
    found = rounds.config_contents(p.select(F.right("path", F.lit(6)).alias("file")).distinct(), packed)
    return found.select("file", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


#: Payloads as they come and broken ones: cut off, missing, without the key, of another type, no object.
PAYLOAD = "CASE event_id % 9 WHEN 1 THEN left(props, 4) WHEN 2 THEN NULL WHEN 3 THEN replace(props, '\"k\"', '\"other\"') WHEN 4 THEN '{\"k\": \"many\"}' WHEN 5 THEN '[1, 2]' WHEN 6 THEN replace(props, '}', ', \"note\": {\"by\": \"u1\"}}') WHEN 7 THEN '{\"k\": null}' ELSE props END"


@query(f"""WITH p AS (SELECT event_id, {PAYLOAD} AS p FROM events), j AS (SELECT *, CASE WHEN json_valid(p) THEN p END AS j FROM p), o AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS o FROM j)
SELECT event_id, coalesce(TRY_CAST(json_extract_string(o, '$.k') AS BIGINT), -1) AS k, json_extract_string(o, '$.note.by') AS noted,
CASE WHEN p IS NULL THEN 'no payload' WHEN j IS NULL THEN 'no JSON' WHEN o IS NULL THEN 'no object' WHEN json_extract_string(o, '$.k') IS NULL THEN 'k is missing' WHEN TRY_CAST(json_extract_string(o, '$.k') AS BIGINT) IS NULL THEN 'k is no long' END AS refused FROM o""")
def payloads_read(spark, sf):
    rows = payloads.read(load(spark, sf, "events").select("event_id", F.expr(PAYLOAD).alias("p")), "p", {"k": "$.k as long"}, {"noted": "$.note.by as string"})
    return rows.select("event_id", F.coalesce("fields.k", F.lit(-1)).alias("k"), "fields.noted", "refused")


def _part(number: int, title: str, rows: str) -> str:
    """SQL of a section: rows(place, part, line), below their title if there are any."""
    return f"SELECT {number} AS section, place, part, line FROM ({rows}) UNION ALL SELECT {number}, 0, 0, '{title}' WHERE EXISTS (SELECT 1 FROM ({rows}))"


def _top(rows: str, limit: int, order: str, line: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS place, 0 AS part, {line} AS line FROM ({rows}) QUALIFY place <= {limit}"


def _nest(number: int, title: str, rows: str, entries: int, items: int) -> str:
    """SQL of lists inside entries: rows(key, item, seq)."""
    t = f"(SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS place FROM ({rows}) GROUP BY key QUALIFY place <= {entries})"
    k = f"(SELECT key, item, row_number() OVER (PARTITION BY key ORDER BY seq, item) AS k FROM ({rows}) QUALIFY k <= {items})"
    return _part(number, title, f"SELECT place, 0 AS part, concat('  ', key, ':') AS line FROM {t} UNION ALL SELECT place, k, concat('    ', item) FROM {t} t JOIN {k} k USING (key) UNION ALL SELECT place, {items + 1}, concat('    and ', n - {items}, ' more') FROM {t} WHERE n > {items}")


def _heads(rows: str, entries: int, items: int, order: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS place, 0 AS part, concat('  ', key, ': ', array_to_string(items[1:{items}], ', '), CASE WHEN n > {items} THEN concat(' and ', n - {items}, ' more') ELSE '' END) AS line FROM (SELECT key, count(*) AS n, min(seq) AS seq, list(item ORDER BY seq, item) AS items FROM ({rows}) GROUP BY key) QUALIFY place <= {entries}"


def _brief(*parts: str) -> str:
    return f"SELECT section::INT AS section, place::INT AS place, part::INT AS part, line FROM ({' UNION ALL '.join(parts)})"


FILES = "SELECT concat('d', doc_id % 7, '/', source, '/f', doc_id, '.', lang) AS path, strlen(text) AS size, len(string_split(text, chr(10))) AS lines FROM documents"
IMPORTS = "SELECT concat('d', l_suppkey % 5, '/f', l_partkey, '.ts') AS path, CASE l_suppkey % 3 WHEN 0 THEN './' WHEN 1 THEN '@scope/' ELSE '' END || 's' || l_suppkey AS source, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"
EXPORTED = "SELECT concat('d', event_id % 3, '/f', user_id, '.ts') AS path, concat(event_type, event_id % 11) AS name, event_id AS seq FROM events"
NOTES = "SELECT concat('d', n_regionkey, '/m', n_nationkey) AS path, n_name AS module, n_nationkey AS seq FROM nation"


def _files(spark, sf):
    d = load(spark, sf, "documents")
    return d.select(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.octet_length("text").alias("size"), T.line_count("text").alias("lines"))


def _imports(spark, sf):
    source = F.concat(F.expr("CASE l_suppkey % 3 WHEN 0 THEN './' WHEN 1 THEN '@scope/' ELSE '' END"), F.lit("s"), F.col("l_suppkey").cast("string"))
    return load(spark, sf, "lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/f"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("path"), source.alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def _exported(spark, sf):
    return load(spark, sf, "events").select(F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"), F.lit("/f"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"), F.concat("event_type", (F.col("event_id") % 11).cast("string")).alias("name"), F.col("event_id").alias("seq"))


def _modules(spark, sf):
    n = load(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.concat(F.lit("d"), F.col("n_regionkey").cast("string"), F.lit("/m"), F.col("n_nationkey").cast("string")).alias("path"), F.lower("n_name").alias("purpose"), F.transform(F.sequence(F.lit(0), F.col("n_nationkey")), lambda i: F.concat(F.lit("f"), i.cast("string"))).alias("files"))


@query(_brief(
    _part(1, "# Size", f"SELECT unnest([1, 2, 3]) AS place, 0 AS part, unnest([concat('files: ', f), concat('folders: ', d), concat('lines: ', l)]) AS line FROM (SELECT count(*) AS f, sum(lines)::BIGINT AS l, (SELECT count(DISTINCT x) FROM (SELECT unnest([split_part(path, '/', 1), concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))]) AS x FROM ({FILES}))) AS d FROM ({FILES}))"),
    _part(2, "# Extensions", _top("SELECT lang, count(*) AS n FROM documents GROUP BY 1", briefs.EXTENSIONS, "n DESC, lang", "concat('  .', lang, ': ', n)")), _part(3, "# Largest files", _top(FILES, briefs.LARGEST, "size DESC, path", "concat('  ', path, ': ', lines, ' lines, ', size, ' bytes')")),
    _part(4, "# Dependencies", _top("SELECT * FROM part", briefs.DEPENDENCIES, "p_partkey", "concat('  ', p_name, '@', p_brand, ' (', p_type, ')')")), _part(5, "# Latest commits", _top("SELECT * FROM orders", briefs.COMMITS, "o_orderkey", "concat('  ', left(md5(o_orderkey::VARCHAR), 7), ' ', o_orderpriority, ' (', o_custkey, ', ', o_orderstatus, ')')")),
    _part(6, "# Contributors", _top("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", briefs.PEOPLE, "n DESC, n_name", "concat('  ', n_name, ': ', n)")), _part(7, "# Documentation", "SELECT 1 AS place, 0 AS part, concat('  ', count(*), ' documents, 0 of them readmes') AS line FROM pages"),
))
def brief_overview(spark, sf):
    o = load(spark, sf, "orders")
    people = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("commits"))
    return briefs.overview({
        "files": _files(spark, sf), "deps": load(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.col("p_type").alias("type"), F.col("p_partkey").alias("seq")), "people": people, "docs": load(spark, sf, "pages").select(F.expr(PATHS).alias("path")),
        "commits": o.select(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"), F.col("o_orderpriority").alias("message"), F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("date"), F.col("o_orderkey").alias("seq")),
    })


IMPORTED_SQL = f"SELECT source, count(*) AS n FROM ({IMPORTS}) GROUP BY 1"
FOLDERS_SQL = f"SELECT dir, count(*) FILTER (own) AS children FROM (SELECT unnest([split_part(path, '/', 1), concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))]) AS dir, unnest([false, true]) AS own FROM ({FILES})) GROUP BY 1"


@query(_brief(
    _part(1, "# Languages", _top("SELECT lang, count(*) AS n FROM documents GROUP BY 1", 1000, "n DESC, lang", "concat('  ', lang, ': ', n, ' files')")), _part(2, "# Folders", _top(FOLDERS_SQL, briefs.FOLDERS, "dir", "concat('  ', dir, '/ (', children, ')')")),
    _nest(3, "# Imports of files", f"SELECT path AS key, source AS item, seq FROM ({IMPORTS})", briefs.IMPORTERS, briefs.IMPORTS_2), _part(4, "# Most imported", _top(IMPORTED_SQL, briefs.IMPORTED, "n DESC, source", "concat('  ', source, ': ', n)")),
    _part(5, "# Exports of files", _heads(f"SELECT path AS key, name AS item, seq FROM ({EXPORTED})", briefs.EXPORTERS_2, briefs.EXPORTS_2, "n DESC, key")),
))
def brief_modules(spark, sf):
    return briefs.modules({"files": _files(spark, sf), "parsed": load(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("language")), "imports": _imports(spark, sf), "exports": _exported(spark, sf)})


@query(_brief(
    _part(1, "# Modules", _top(NOTES, 1000, "seq", f"concat('  ', module, ' (', path, '): ', lower(module), '; ', array_to_string(list_transform(range(0, least(seq + 1, {briefs.MODULE_FILES})), lambda i: concat('f', i)), ', '), CASE WHEN seq + 1 > {briefs.MODULE_FILES} THEN concat(' and ', seq + 1 - {briefs.MODULE_FILES}, ' more') ELSE '' END)")),
    _part(2, "# Entry points", _top("SELECT * FROM region", 1000, "r_regionkey", "concat('  r', r_regionkey, ' (cli): ', r_name)")), _part(3, "# Exports of files", _heads(f"SELECT path AS key, name AS item, seq FROM ({EXPORTED})", briefs.EXPORTERS_3, briefs.EXPORTS_3, "n DESC, key")),
    _nest(4, "# Imports of files", f"SELECT path AS key, source AS item, seq FROM ({IMPORTS})", briefs.IMPORTERS, briefs.IMPORTS_3), _part(5, "# Tests", _top("SELECT * FROM supplier", briefs.TESTS, "s_suppkey", "concat('  t/s', s_suppkey, ' (', s_name, ', ', s_nationkey, ')')")),
))
def brief_features(spark, sf):
    entries = load(spark, sf, "region").select(F.col("r_regionkey").alias("seq"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.lit("cli").alias("type"), F.col("r_name").alias("description"))
    return briefs.features({"modules": _modules(spark, sf), "entries": entries, "exports": _exported(spark, sf), "imports": _imports(spark, sf), "tests": _tests(spark, sf)})


def _tests(spark, sf):
    return load(spark, sf, "supplier").select(F.concat(F.lit("t/s"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("framework"), F.col("s_nationkey").alias("tests"), F.col("s_suppkey").alias("seq"))


LAYERED = "SELECT DISTINCT concat(['services', 'api', 'x', 'y', 'Views'][o_orderkey % 5 + 1], o_custkey % 9) AS dir, ['service', 'api', NULL, NULL, 'view'][o_orderkey % 5 + 1] AS layer FROM orders"


@query(_brief(
    _part(1, "# Links of modules", _top("SELECT a.n_name AS a, b.n_name AS b, a.n_nationkey AS seq FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25", 1000, "seq", "concat('  ', a, ' -> ', b, ' (uses): e', seq)")),
    _part(2, "# Modules", _top(NOTES, 1000, "seq", f"concat('  ', module, ' (', path, '): ', lower(module), '; ', array_to_string(list_transform(range(0, least(seq + 1, {briefs.MODULE_API})), lambda i: concat('f', i)), ', '), CASE WHEN seq + 1 > {briefs.MODULE_API} THEN concat(' and ', seq + 1 - {briefs.MODULE_API}, ' more') ELSE '' END)")),
    _part(3, "# Flows", _top("SELECT conv_id, array_to_string(list(role ORDER BY turn), ' -> ') AS p FROM conversations GROUP BY 1", 1000, "conv_id", "concat('  c', conv_id, ': ', p, '; talk')")), _part(4, "# Features", _top("SELECT * FROM part", briefs.FEATURES, "p_partkey", "concat('  ', p_name, ': ', p_type, ' [', p_brand, ', core]')")),
    _part(5, "# Kinds of imports", _top(f"SELECT CASE WHEN starts_with(source, '.') THEN 'relative' WHEN starts_with(source, '@') THEN 'scoped-package' ELSE 'package' END AS class, count(*) AS n FROM ({IMPORTS}) GROUP BY 1", 10, "n DESC, class", "concat('  ', class, ': ', n)")),
    _part(6, "# Folders named like layers", _top(f"SELECT * FROM ({LAYERED}) WHERE layer IS NOT NULL", briefs.LAYERS, "dir", "concat('  ', dir, ' (', layer, ')')")), _part(7, "# Files by folder", _top("SELECT concat(['services', 'api', 'x', 'y', 'Views'][o_orderkey % 5 + 1], o_custkey % 9) AS top, count(*) AS n FROM orders GROUP BY 1", briefs.TOP_FOLDERS, "n DESC, top", "concat('  ', top, '/: ', n)")),
))
def brief_architecture(spark, sf):
    n = load(spark, sf, "nation")
    links = n.join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b")), F.expr("k = (n_nationkey * 7 + 3) % 25")).select(F.col("n_name").alias("a"), "b", F.col("n_nationkey").alias("seq"), F.lit("uses").alias("type"), F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("evidence"))
    flows = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("path")).select("seq", F.concat(F.lit("c"), F.col("seq").cast("string")).alias("name"), "path", F.lit("talk").alias("description"))
    made = load(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand", F.lit("core")).alias("modules"))
    files = load(spark, sf, "orders").select(F.concat(F.expr("array('services', 'api', 'x', 'y', 'Views')[o_orderkey % 5]"), (F.col("o_custkey") % 9).cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string")).alias("path"))
    return briefs.architecture({"relationships": links, "modules": _modules(spark, sf).withColumnRenamed("files", "api"), "flows": flows, "features": made, "imports": _imports(spark, sf), "files": files})


#: Modules of suppliers by nation, remarks from events, tests that hold a module's number anywhere in their path.
EDGE = """WITH m AS (SELECT concat('n', s_nationkey, 'x') AS module, concat('d/', s_nationkey) AS path, list(concat('f', s_suppkey)) AS files FROM supplier GROUP BY s_nationkey),
p AS (SELECT concat('f', s_suppkey) AS path, concat('fn', s_suppkey) AS fn, s_name AS ex FROM supplier),
t AS (SELECT concat('f', user_id) AS path, event_id AS line, upper(event_type) AS marker, concat('at ', value) AS text, event_id AS seq FROM events),
u AS (SELECT concat('t/n', c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END, '/c', c_custkey) AS path, c_mktsegment AS framework, c_custkey % 5 AS tests, c_custkey AS seq FROM customer),
o AS (SELECT module, unnest(files) AS path FROM m),
a AS (SELECT module, 1 AS section, 1 AS place, concat('  ', module, ' (', path, '): ', len(files), ' files') AS line FROM m
 UNION ALL SELECT module, 2, row_number() OVER (PARTITION BY module ORDER BY path), concat('  ', path, '; functions: ', fn, '; exports: ', ex) FROM o JOIN p USING (path)
 UNION ALL SELECT module, 3, row_number() OVER (PARTITION BY module ORDER BY seq), concat('  ', marker, ' ', text, ' (', path, ':', line, ')') FROM o JOIN t USING (path)
 UNION ALL SELECT module, 4, row_number() OVER (PARTITION BY module ORDER BY seq), concat('  ', u.path, ' (', framework, ', ', tests, ')') FROM m JOIN u ON contains(u.path, m.module)),
l AS (SELECT * FROM a WHERE place <= CASE section WHEN 1 THEN 1 WHEN 2 THEN 20 WHEN 3 THEN 15 ELSE 10 END)
SELECT module, section::INT AS section, place::INT AS place, 0 AS part, line FROM l UNION ALL SELECT DISTINCT module, section, 0, 0, CASE section WHEN 1 THEN '# Module' WHEN 2 THEN '# Sources' WHEN 3 THEN '# Remarks' ELSE '# Tests' END FROM l"""


@query(EDGE)
def brief_edge_cases(spark, sf):
    s, e, c = load(spark, sf, "supplier"), load(spark, sf, "events"), load(spark, sf, "customer")
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    mods = s.groupBy("s_nationkey").agg(F.collect_list(name("f", "s_suppkey")).alias("files")).select(F.concat(name("n", "s_nationkey"), F.lit("x")).alias("module"), name("d/", "s_nationkey").alias("path"), "files")
    parsed = s.select(name("f", "s_suppkey").alias("path"), F.array(name("fn", "s_suppkey")).alias("functions"), F.array("s_name").alias("exports"))
    todos = e.select(name("f", "user_id").alias("path"), F.col("event_id").alias("line"), F.upper("event_type").alias("marker"), name("at ", "value").alias("text"), F.col("event_id").alias("seq"))
    tests = c.select(F.concat(name("t/n", "c_nationkey"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END"), name("/c", "c_custkey")).alias("path"), F.col("c_mktsegment").alias("framework"), (F.col("c_custkey") % 5).alias("tests"), F.col("c_custkey").alias("seq"))
    return briefs.edge_cases({"modules": mods, "parsed": parsed, "todos": todos, "tests": tests})


#: Pages as files: every hundredth order of paths is one of a known system, and all of them are packed.
CI_PATH = "concat('p', page_id, CASE page_id % 5 WHEN 0 THEN '/.github/workflows/ci.yml' WHEN 1 THEN '/Dockerfile' WHEN 2 THEN '/Jenkinsfile' ELSE '/src/a.ts' END)"


@query(_brief(
    _part(1, "# Env files", _top("SELECT concat('.env', o_custkey % 20) AS path, list(DISTINCT concat('V', o_orderkey % 50) ORDER BY concat('V', o_orderkey % 50)) AS v FROM orders GROUP BY 1", 1000, "path", f"concat('  ', path, ': ', array_to_string(v[1:{briefs.VARIABLES}], ', '), CASE WHEN len(v) > {briefs.VARIABLES} THEN concat(' and ', len(v) - {briefs.VARIABLES}, ' more') ELSE '' END)")),
    _part(2, "# Variables in code", _heads("SELECT concat('K', user_id) AS key, concat('f', event_id % 7, ':', event_id) AS item, event_id AS seq FROM events", briefs.REFERENCED, briefs.SPOTS, "seq, key")),
    _part(3, "# Build and deployment files", f"SELECT place, unnest(CASE WHEN kept THEN [0, 1] ELSE [0] END) AS part, unnest(CASE WHEN kept THEN [said, body] ELSE [said] END) AS line FROM (SELECT row_number() OVER (ORDER BY path) AS place, page_id % 10 > 2 AND html IS NOT NULL AS kept, concat('  ', path, [' (GitHub Actions)', '', ' (Jenkins)'][page_id % 5 + 1]) AS said, left(html, 3000) AS body FROM (SELECT *, {CI_PATH} AS path FROM pages) WHERE page_id % 5 < 3 QUALIFY place <= 1000)"),
    _nest(4, "# Production dependencies", "SELECT concat('m', p_size % 6, '/package.json (npm)') AS key, concat(p_name, '@', p_brand) AS item, p_partkey AS seq FROM part WHERE p_partkey % 3 > 0", 1000, briefs.PRODUCTION).replace("concat('  ', key, ':')", "concat('  ', key)"),
))
def brief_deployment(spark, sf):
    o, e, p, g = (load(spark, sf, t) for t in ("orders", "events", "part", "pages"))
    name = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    env = o.groupBy(name(".env", F.col("o_custkey") % 20).alias("path")).agg(F.sort_array(F.collect_set(name("V", F.col("o_orderkey") % 50))).alias("variables"))
    refs = e.select(name("K", F.col("user_id")).alias("variable"), name("f", F.col("event_id") % 7).alias("file"), F.col("event_id").alias("line"), F.col("event_id").alias("seq"))
    files = g.select(F.expr(CI_PATH).alias("path"), F.col("page_id").alias("rank"), F.when(F.col("page_id") % 10 > 2, "full").otherwise("skip").alias("tier"), F.col("html").alias("content"))
    deps = p.select(F.concat(name("m", F.col("p_size") % 6), F.lit("/package.json")).alias("path"), F.lit("npm").alias("manager"), F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.when(F.col("p_partkey") % 3 > 0, "production").otherwise("development").alias("type"), F.col("p_partkey").alias("seq"))
    return briefs.deployment({"env_files": env, "env_refs": refs, "files": files.select("path"), "packed": files, "deps": deps})
