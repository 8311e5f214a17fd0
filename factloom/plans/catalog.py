"""Queries over the driver's tables, each with the same query in SQL where SQL can express it.

The tables stand in for files, commits, references and documents; the docstring of each operator says what it is for.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import chunks, facts, graph, incremental, reports, retrieval, scoring
from factloom.sources import manifests
from factloom.streaming import sessions
from factloom.symbols import extract

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT coalesce(nullif(source, ''), '(no extension)') AS extension, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY 1")
def file_ext_histogram(spark, sf):
    return facts.by_extension(load(spark, sf, "documents").select(F.col("source").alias("extension")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def largest_files_top20(spark, sf):
    return facts.top(load(spark, sf, "documents").select("doc_id", "n_chars"), 20, F.desc("n_chars"), "doc_id")


PATHS = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(f"WITH p AS (SELECT string_split({PATHS}, '/') AS p FROM pages), u AS (SELECT array_to_string(p[1:i], '/') AS dir, i = len(p) - 1 AS own FROM p, unnest(range(1, len(p))) t(i)) SELECT dir, count(*) FILTER (own) AS children FROM u GROUP BY dir")
def ancestor_dirs(spark, sf):
    return facts.ancestors(load(spark, sf, "pages").select(F.expr(PATHS).alias("path")))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents")
def line_count(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.line_count("text").alias("lines"))


@query("SELECT count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(strlen(text))::BIGINT AS bytes FROM documents")
def tree_totals(spark, sf):
    return load(spark, sf, "documents").agg(F.count("*").alias("files"), F.sum(T.line_count("text")).alias("lines"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query("SELECT p_partkey, CAST(floor((p_size * 10000 - 3000 - 4096) * 0.9::DOUBLE) AS BIGINT) AS budget FROM part")
def token_budget(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.token_budget(F.col("p_size") * 10000).alias("budget"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_docs(spark, sf):
    return load(spark, sf, "documents").groupBy(T.content_hash("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


@query("""SELECT CAST(n.doc_id AS VARCHAR) AS path, CASE WHEN n.source = 'src1' THEN 'new' ELSE 'modified' END AS status
FROM documents n WHERE n.source = 'src1' OR n.source = 'src2'""")
def change_set(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"), "source")
    before = d.filter("source != 'src1'").select("path", F.when(F.col("source") == "src2", F.lit("edited")).otherwise(F.col("hash")).alias("hash"))
    return facts.changed(d.select("path", "hash"), before)


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS commits FROM events GROUP BY 1")
def activity_by_month(spark, sf):
    return facts.by_month(load(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date")))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def activity_by_day(spark, sf):
    e = sessions.by_window(load(spark, sf, "events").select("ts", "event_type"))
    return e.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


WHO = "concat('u', user_id % 40) AS name, concat('m', user_id % 60, '@x') AS email"


@query(f"SELECT {WHO}, count(*) AS commits FROM events GROUP BY 1, 2")
def contributors_all(spark, sf):
    return facts.contributors(load(spark, sf, "events").selectExpr("concat('u', user_id % 40) as name", "concat('m', user_id % 60, '@x') as email"))


@query(f"SELECT {WHO}, count(*) AS commits FROM events GROUP BY 1, 2 ORDER BY commits DESC, name, email LIMIT 10")
def contributors(spark, sf):
    return facts.top(contributors_all(spark, sf), 10, F.desc("commits"), "name", "email")


@query("SELECT l_partkey, count(*) AS changes FROM lineitem GROUP BY 1 ORDER BY changes DESC, l_partkey LIMIT 30")
def most_changed_top30(spark, sf):
    n = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("changes"))
    return facts.top(n, 30, F.desc("changes"), "l_partkey")


@query("""WITH n AS (SELECT l_partkey AS path, l_suppkey AS author, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first, author DESC) AS k FROM n) SELECT path, author AS owner, n AS changes FROM r WHERE k = 1""")
def ownership_argmax(spark, sf):
    c = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("seq"))
    return facts.owners(c)


@query("SELECT age, count(*) AS n FROM (SELECT CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 30 THEN 'active' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') >= 90 THEN 'stale' ELSE 'between' END AS age FROM orders) GROUP BY 1")
def branch_age_class(spark, sf):
    b = load(spark, sf, "orders").select(F.col("o_orderdate").alias("commit_ts"))
    return facts.branch_age(b, F.lit("1998-08-02").cast("date")).groupBy("age").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS percent FROM orders GROUP BY ALL")
def category_pct(spark, sf):
    o = load(spark, sf, "orders").select(F.struct("o_orderpriority", "o_orderstatus").alias("k"))
    return facts.shares(o, "k").select("k.o_orderpriority", "k.o_orderstatus", "n", "percent")


MARKS = "CASE event_type WHEN 'click' THEN 'TODO: ' WHEN 'purchase' THEN 'fixme ' WHEN 'error' THEN 'HACK: ' WHEN 'signup' THEN 'note: ' ELSE 'TODONT ' END"


@query(f"""WITH l AS (SELECT event_id, concat('// ', {MARKS}, event_type, ' #', event_id, ' see AB-', user_id) AS text FROM events),
m AS (SELECT event_id, text AS line, upper(regexp_extract(text, '(?i)\\b(TODO|FIXME|HACK|NOTE)(?::\\s*|\\s+)(.*)', 1)) AS marker, trim(regexp_extract(text, '(?i)\\b(TODO|FIXME|HACK|NOTE)(?::\\s*|\\s+)(.*)', 2)) AS text FROM l)
SELECT CAST(event_id AS VARCHAR) AS path, 1 AS line, marker, CASE marker WHEN 'TODO' THEN 'tasks' WHEN 'NOTE' THEN 'notes' ELSE 'bugs' END AS category, text,
  array_to_string(regexp_extract_all(line, '(#\\d+|[A-Z]{{2,}}-\\d+)', 1), ',') AS refs FROM m WHERE marker <> ''""")
def todo_scan(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.expr(f"concat('// ', {MARKS}, event_type, ' #', event_id, ' see AB-', user_id)").alias("content"))
    return facts.todos(e).select("path", "line", "marker", "category", "text", F.array_join("issue_refs", ",").alias("refs"))


@query("SELECT event_id, concat('EV_', upper(event_type), ',U', user_id) AS vars FROM events")
def env_refs(spark, sf):
    line = F.expr("concat('x = process.env.EV_', upper(event_type), ' || os.getenv(\"U', user_id, '\") || process.env.lower')")
    return load(spark, sf, "events").select("event_id", F.array_join(T.env_refs(line), ",").alias("vars"))


#: Documents as test code: words of their texts become calls, definitions and attributes of the frameworks.
TESTS = "replace(replace(replace(replace(replace(text, ' the ', concat(chr(10), 'it (')), ' of ', concat(chr(10), '  def test_x')), ' and ', concat(chr(10), 'func TestA')), ' to ', ' #[test] '), ' a ', ' describe( func Test_ ')"


@query(f"""WITH t AS (SELECT doc_id, {TESTS} AS c FROM documents) SELECT doc_id, len(regexp_extract_all(c, '\\b(?:it|test|describe)\\s*\\(')) AS vitest, len(regexp_extract_all(c, '\\b(?:it|describe)\\s*\\(')) AS mocha, len(regexp_extract_all(c, '\\bdef\\s+test_')) AS pytest,
 len(regexp_extract_all(c, '\\bfunc\\s+Test[A-Z]')) AS go_test, len(regexp_extract_all(c, '#\\[test\\]')) + len(regexp_extract_all(c, '#\\[cfg\\(test\\)\\]')) AS rust_test FROM t""")
def count_tests(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.expr(TESTS).alias("c"))
    return d.select("doc_id", *(T.count_tests("c", f).cast("long").alias(f) for f in ("vitest", "mocha", "pytest", "go_test", "rust_test")))


#: Documents as lists of requirements: a word a line, some with versions, comments, flags and extras.
NEEDED = "replace(replace(replace(replace(text, ' a ', concat(' # ', chr(10), '--x ')), ', ', '>=1.0 '), '. ', '[x]==2 '), ' ', chr(10))"
WIDE = r"[\s\x{0B}\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({NEEDED}, chr(10))) AS l FROM documents), c AS (SELECT doc_id, regexp_replace(l, '^{WIDE}|{WIDE}$', '', 'g') AS l FROM l)
SELECT doc_id::VARCHAR AS path, regexp_extract(l, '^([a-zA-Z0-9_.-]+)\\s*([><=!~]+.*)?', 1) AS name, coalesce(nullif(trim(regexp_extract(l, '^([a-zA-Z0-9_.-]+)\\s*([><=!~]+.*)?', 2)), ''), '*') AS version, 'production' AS type
FROM c WHERE regexp_matches(l, '^[a-zA-Z0-9_.-]') AND NOT regexp_matches(l, '^(#|-r|-e|-i|--)')""")
def manifest_requirements(spark, sf):
    return manifests.requirements(load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(NEEDED).alias("content")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, concat('ex.org/a', p_size) AS name, concat('v1.', p_size, '.0') AS version, 'production' AS type FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'ex.org/one', 'v0.1.0', 'production' FROM part")
def manifest_go(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr("concat('module m\\nrequire (\\n\\tex.org/a', p_size, ' v1.', p_size, '.0\\n)\\nrequire ex.org/one v0.1.0\\n')").alias("content"))
    return manifests.go_mod(p)


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, concat('a', p_size) AS name, concat('^', p_size) AS version, 'production' AS type FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'b', '1', 'development' FROM part")
def manifest_package_json(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr("""concat('{"dependencies":{"a', p_size, '":"^', p_size, '"},"devDependencies":{"b":"1"}}')""").alias("content"))
    return manifests.package_json(p)


EDGES = "SELECT DISTINCT concat('m', l_partkey % 50, '/p', l_partkey, '.ts') AS src, concat('../m', l_suppkey % 50, '/s', l_suppkey, '.js') AS specifier FROM lineitem"
KNOWN = "SELECT concat('m', s_suppkey % 50, '/s', s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.md' END) AS path FROM supplier"
RESOLVED = f"""e AS ({EDGES}), k AS ({KNOWN}),
r AS (SELECT e.src, e.specifier, k.path AS dst FROM e JOIN k ON k.path IN (regexp_replace(substr(e.specifier, 4), '\\.js$', '.ts'), regexp_replace(substr(e.specifier, 4), '\\.js$', '/index.ts')))"""


#: Imports that a task resolves at most, about.
IMPORTS = 1 << 17


def _resolved(spark, sf):
    lines = load(spark, sf, "lineitem")
    lines.createOrReplaceTempView("lineitem")
    load(spark, sf, "supplier").createOrReplaceTempView("supplier")
    parts = -(-lines.count() // IMPORTS) or 1
    every = spark.sql(EDGES.replace("SELECT DISTINCT", "SELECT")).repartition(parts, "src", "specifier").distinct()
    return graph.resolve(every, spark.sql(KNOWN), parts=parts)


@query(f"WITH {RESOLVED} SELECT * FROM r")
def import_resolution(spark, sf):
    return _resolved(spark, sf)


@query(f"WITH {RESOLVED} SELECT dst AS path, count(DISTINCT src) AS importers FROM r GROUP BY 1")
def importer_count(spark, sf):
    return graph.importers(_resolved(spark, sf))


@query(f"WITH {RESOLVED} SELECT DISTINCT split_part(src, '/', 1) AS a, split_part(dst, '/', 1) AS b FROM r WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1)")
def module_graph(spark, sf):
    edges = graph.file_graph(_resolved(spark, sf))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.lift(edges, nodes.select("node", T.top_dir("node").alias("grp"), F.lit(0).alias("seq")))


@query("WITH l AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT a FROM l UNION SELECT b FROM l)")
def isolated_modules(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o, c, s = load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "supplier")
    e = li.join(o.select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    return graph.isolated(load(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), e.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")))


#: A path for each part: entry points, configurations, tests, look-alikes of each, and plain files.
SCORED = """CASE p_partkey % 16 WHEN 0 THEN concat('src/p', p_partkey, '.test.ts') WHEN 1 THEN concat('pkg', p_partkey, '/package.json') WHEN 2 THEN concat('d', p_partkey, '/index.ts') WHEN 3 THEN concat('cli.x', p_partkey)
 WHEN 4 THEN concat('bin', p_partkey, '/cli.ts') WHEN 5 THEN concat('.env.p', p_partkey) WHEN 6 THEN concat('vite', p_partkey, '.ts') WHEN 7 THEN concat('a/b', p_partkey, '.config.js') WHEN 8 THEN concat('tests/t', p_partkey, '.py')
 WHEN 9 THEN concat('x', p_partkey, '/__tests__/a.ts') WHEN 10 THEN concat('p', p_partkey, '/yarn.lock') WHEN 11 THEN concat('src/server.p', p_partkey) WHEN 12 THEN concat('e', p_partkey, '/main.spec.ts') WHEN 13 THEN concat('tsconfig.', p_partkey)
 WHEN 14 THEN concat('mainly', p_partkey, '.go') ELSE concat('src/p', p_partkey, '.ts') END"""
BARE = r"regexp_replace(path, '\\.[^./]+$', '')"


@query(rf"""WITH f AS (SELECT {SCORED} AS path, p_partkey, p_size FROM part),
n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS importers, count(*) AS changes FROM lineitem GROUP BY 1),
g AS (SELECT f.*, regexp_matches(path, '^(index|main|app|server|cli)\.[^/]+$') OR regexp_matches(path, '/(index|main|app|server)\.[^/]+$') AS entry,
 regexp_matches(path, '\.config\.[^/]+$') OR regexp_matches(path, '^\.?(babel|eslint|prettier|jest|vitest|webpack|tsconfig|rollup|vite)') OR regexp_matches(path, '^\.env') OR regexp_matches(path, '^(package\.json|Cargo\.toml|go\.mod|pyproject\.toml|Makefile|Dockerfile)$') AS config,
 regexp_matches(path, '\.test\.') OR regexp_matches(path, '\.spec\.') OR contains(path, '__tests__/') OR contains(path, '__test__/') AS test FROM f WHERE path NOT LIKE '%/yarn.lock')
SELECT path, CAST(greatest(0, least(100, CASE WHEN entry THEN 30 ELSE 0 END + least(3 * coalesce(importers, 0), 30) + least(2 * p_size, 20) + least(coalesce(changes, 0), 10) + CASE WHEN p_size > 25 THEN 10 ELSE 0 END
 + CASE WHEN config THEN 15 ELSE 0 END - CASE WHEN test THEN 15 ELSE 0 END)) AS INT) AS score FROM g LEFT JOIN n ON l_partkey = p_partkey""")
def file_score(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_size", F.expr(SCORED).alias("path"))
    n = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("importers"), F.count("*").alias("changes"))
    both = p.join(n, F.expr("l_partkey = p_partkey"))
    importers = both.select(F.when((F.col("p_partkey") % 3 == 0) & F.contains("path", F.lit("/")) & ~F.startswith("path", F.lit("src/server")), T.strip_extension("path")).otherwise(F.col("path")).alias("path"), "importers")  # some are known by the path without its extension
    facts_of = p.select("path", F.col("p_size").alias("exports"), (F.col("p_size") > 25).cast("int").alias("todos"))
    return scoring.by_score(scoring.score(facts_of, [importers, both.select("path", "changes")])).select("path", "score")


PACK_BUDGET = 40_000


@query(f"""WITH RECURSIVE q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1),
d AS (SELECT source, CAST(documents.doc_id AS VARCHAR) AS path, 50 * coalesce(q, 0) AS score, text, string_split(text, chr(10)) AS l, documents.doc_id AS id FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id),
c AS (SELECT source, path, CAST(ceil(length(text) / 4.0) AS BIGINT) AS whole,
 CAST(ceil((length(concat('// FILE: ', path, ' (', len(l), ' lines)')) + list_sum(list_transform(l[1:20], lambda x: length(x) + 4)) + CASE WHEN len(l) > 20 THEN length(concat(chr(10), '// ... (', len(l) - 20, ' more lines)')) ELSE 0 END) / 4.0) AS BIGINT) AS brief,
 row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM d),
t AS (SELECT source, sum(whole) <= {PACK_BUDGET} AS fits FROM c GROUP BY 1),
r AS (SELECT source, CAST(0 AS BIGINT) AS rank, CAST({PACK_BUDGET} AS BIGINT) AS room, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS tier, CAST(0 AS BIGINT) AS tokens FROM t WHERE NOT fits
 UNION ALL SELECT c.source, c.rank, room - CASE WHEN whole <= room THEN whole WHEN brief <= room THEN brief ELSE 0 END, c.path, CASE WHEN whole <= room THEN 'full' WHEN brief <= room THEN 'signatures' ELSE 'skip' END,
 CASE WHEN whole <= room THEN whole WHEN brief <= room THEN brief ELSE 0 END FROM r JOIN c ON c.source = r.source AND c.rank = r.rank + 1)
SELECT source, path, tier, tokens, rank FROM r WHERE rank > 0 UNION ALL SELECT c.source, c.path, 'full', c.whole, c.rank FROM c JOIN t ON t.source = c.source WHERE fits""")
def pack_greedy(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left")
    rows = d.select("source", F.col("doc_id").cast("string").alias("path"), (50 * F.coalesce("q", F.lit(0))).alias("score"), "doc_id", F.col("text").alias("content"), F.lit(None).cast(extract.AST).alias("ast"), F.lit(False).alias("changed"))
    ranked = scoring.costs(rows).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return scoring.pack(ranked, PACK_BUDGET, ("source",)).select("source", "path", "tier", "tokens", "rank")


@query(f"WITH p AS ({SQL['pack_greedy'].replace('WITH RECURSIVE', 'WITH RECURSIVE ')}) SELECT source, count(*) AS files, count(*) FILTER (tier = 'full') AS full, count(*) FILTER (tier = 'signatures') AS signatures, count(*) FILTER (tier = 'skip') AS skip, sum(tokens)::BIGINT AS used_tokens, CAST(floor(100.0 * sum(tokens) / {PACK_BUDGET} + 0.5) AS INT) AS utilisation FROM p GROUP BY 1")
def packing_summary(spark, sf):
    return scoring.packing_summary(pack_greedy(spark, sf), PACK_BUDGET, ("source",))


@query("""SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) AS held FROM benchmark b""")
def claim_validation(spark, sf):
    return incremental.validate(load(spark, sf, "benchmark"), load(spark, sf, "documents"), ["text"]).select("item_id", "held")


@query("SELECT count(*) FILTER (h) AS validated, count(*) FILTER (NOT h) AS corrected, count(*) AS total, count(*) FILTER (NOT h)::DOUBLE / count(*) AS drop_rate FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS h FROM documents)")
def validation_summary(spark, sf):
    return incremental.validation_summary(incremental.validate(load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels"), ["doc_id"]))


CHANGED = "s_acctbal < 0"


@query(f"""WITH c AS (SELECT s_suppkey AS path, s_nationkey FROM supplier WHERE {CHANGED}), k AS (SELECT n_name AS renderer, s_suppkey AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT renderer, array_to_string(list_sort(list(DISTINCT k.path)), ',') AS reasons FROM c JOIN k USING (path) WHERE path <> 3 GROUP BY 1""")
def renderer_filter(spark, sf):
    s, n = load(spark, sf, "supplier"), load(spark, sf, "nation")
    claims = s.join(n, F.expr("n_nationkey = s_nationkey")).select(F.col("n_name").alias("renderer"), F.col("s_suppkey").alias("path"))
    hit, _ = incremental.affected(s.filter(CHANGED).select(F.col("s_suppkey").alias("path")), claims, spark.createDataFrame([(3,)], "path long"))
    return hit.select("renderer", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH h AS (SELECT DISTINCT s_nationkey FROM supplier WHERE {CHANGED}) SELECT n_name AS renderer, concat(lower(n_name), '.md') AS filename FROM nation JOIN h ON n_nationkey = s_nationkey WHERE n_regionkey <> 0""")
def staleness(spark, sf):
    s, n = load(spark, sf, "supplier"), load(spark, sf, "nation")
    claims = s.join(n, F.expr("n_nationkey = s_nationkey")).select(F.col("n_name").alias("renderer"), F.col("s_suppkey").alias("path"))
    hit, _ = incremental.affected(s.filter(CHANGED).select(F.col("s_suppkey").alias("path")), claims, spark.createDataFrame([], "path long"))
    docs = n.select(F.col("n_name").alias("renderer"), F.concat(F.lower("n_name"), F.lit(".md")).alias("filename"), "n_regionkey")
    return incremental.stale(hit, docs, docs.filter("n_regionkey = 0")).select("renderer", "filename")


NEEDS = "SELECT n_nationkey::BIGINT AS a, (n_nationkey // 3)::BIGINT AS b FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey - 7 FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey > 7"


def _needs(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    return n.filter("a > 0").withColumn("b", F.floor(F.col("a") / 3)).unionByName(n.filter("a % 5 = 0 and a > 7").withColumn("b", F.col("a") - 7))


@query(f"WITH RECURSIVE e AS ({NEEDS}), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, b FROM r")
def round_closure(spark, sf):
    return graph.closure(_needs(spark, sf))


@query("""WITH t AS (SELECT DISTINCT c_mktsegment AS token FROM customer UNION SELECT concat('  ', n_name) FROM nation UNION SELECT r_name FROM region), g AS (SELECT lower(r_name) AS name, lower(n_name) AS alias FROM region JOIN nation ON n_regionkey = r_regionkey),
w AS (SELECT token, coalesce(alias, lower(trim(token))) AS alias FROM t LEFT JOIN g ON g.name = lower(trim(token))) SELECT DISTINCT token, n_nationkey::VARCHAR AS doc FROM w LEFT JOIN nation ON lower(n_name) = alias""")
def alias_resolution(spark, sf):
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    tokens = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("token")).unionByName(n.select(F.concat(F.lit("  "), "n_name").alias("token"))).unionByName(r.select(F.col("r_name").alias("token"))).distinct()
    groups = r.join(n, F.expr("n_regionkey = r_regionkey")).select(F.lower("r_name").alias("name"), F.lower("n_name").alias("alias"))
    return incremental.resolve_aliases(tokens, n.select(F.lower("n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("doc")), groups)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS chunk_index, 'Root' AS section_path, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS hash FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_headerless(spark, sf):
    d = load(spark, sf, "documents")
    c = chunks.chunk(d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("doc_type"), F.col("source").alias("source_file"), F.col("text").alias("content")))
    return c.select("doc_id", "chunk_index", "section_path", F.sha2("content", 256).alias("hash"))


#: Documents under one header, under two, and as they are.
MARKED = "CASE doc_id % 3 WHEN 0 THEN concat('# ', coalesce(source, ''), chr(10), chr(10), coalesce(text, '')) WHEN 1 THEN concat('before', chr(10), '## ', coalesce(source, ''), chr(10), chr(10), coalesce(text, ''), chr(10), '# End') ELSE coalesce(text, '') END"
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


@query(rf"""WITH RECURSIVE c AS (SELECT doc_id, {MARKED} AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c WHERE regexp_matches(t, '(?m)^#{{1,3}}\s')),
m AS (SELECT *, nullif(length(regexp_extract(line, '^(#{{1,3}})\s+(.+)$', 1)), 0) AS level, trim(regexp_extract(line, '^(#{{1,3}})\s+(.+)$', 2), {BLANKS}) AS title FROM l),
s AS (SELECT *, count(level) OVER w AS sec, max(CASE WHEN level = 1 THEN i END) OVER w AS p1, max(CASE WHEN level = 2 THEN i END) OVER w AS p2, max(CASE WHEN level = 3 THEN i END) OVER w AS p3 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, sec, trim(string_agg(line, chr(10) ORDER BY i), {BLANKS}) AS body, max(p1) AS p1, max(CASE WHEN p2 > coalesce(p1, 0) THEN p2 END) AS p2, max(CASE WHEN p3 > greatest(coalesce(p1, 0), coalesce(p2, 0)) THEN p3 END) AS p3 FROM s GROUP BY doc_id, sec),
h AS (SELECT g.doc_id, g.sec, g.body, coalesce(nullif(concat_ws(' > ', nullif(a.title, ''), nullif(b.title, ''), nullif(d.title, '')), ''), 'Root') AS section_path FROM g LEFT JOIN m a ON a.doc_id = g.doc_id AND a.i = g.p1 LEFT JOIN m b ON b.doc_id = g.doc_id AND b.i = g.p2 LEFT JOIN m d ON d.doc_id = g.doc_id AND d.i = g.p3),
r AS (SELECT doc_id, sec, section_path, body, 0 AS k, 0 AS start, 0 AS last, '' AS piece, false AS done FROM h WHERE length(body) > 2048
 UNION ALL SELECT doc_id, sec, section_path, body, k + 1, CASE WHEN e - 300 > n THEN e - 300 ELSE e END, n, piece, e >= length(body) FROM
  (SELECT *, CASE WHEN p <> '' THEN length(p) ELSE last END AS n, p AS piece FROM (SELECT doc_id, sec, section_path, body, k, start, last, start + x AS e, trim(substr(run, 1, x), {BLANKS}) AS p FROM
   (SELECT *, CASE WHEN start + 2048 >= length(body) THEN length(run) WHEN b2 > 0 AND length(run) - b2 - 1 > 1024 THEN length(run) - b2 + 1 WHEN b1 > 0 AND length(run) - b1 > 1024 THEN length(run) - b1 + 1 WHEN b0 > 0 AND length(run) - b0 > 1024 THEN length(run) - b0 + 1 ELSE 2048 END AS x FROM
    (SELECT *, strpos(reverse(run), concat(chr(10), chr(10))) AS b2, strpos(reverse(run), chr(10)) AS b1, strpos(reverse(run), ' ') AS b0 FROM (SELECT * EXCLUDE (piece), substr(body, start + 1, 2048) AS run FROM r WHERE NOT done)))))),
p AS (SELECT doc_id, sec, k, section_path, piece FROM r WHERE k > 0 AND piece <> '' UNION ALL SELECT doc_id, sec, 0, section_path, body FROM h WHERE length(body) <= 2048
 UNION ALL SELECT doc_id, 0, 0, 'Root', trim(t, {BLANKS}) FROM c WHERE trim(t, {BLANKS}) <> '' AND NOT regexp_matches(t, '(?m)^#{{1,3}}\s'))
SELECT doc_id::VARCHAR AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1 AS INT) AS chunk_index, section_path, CAST(ceil(length(piece) / 4.0) AS INT) AS token_count, sha256(piece) AS hash FROM p""")
def chunk_sections(spark, sf):
    d = load(spark, sf, "documents")
    c = chunks.chunk(d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("doc_type"), F.col("source").alias("source_file"), F.expr(MARKED).alias("content")))
    return c.select("doc_id", "chunk_index", "section_path", "token_count", F.sha2("content", 256).alias("hash"))


def _vector(spark, sf, vec_id=0):
    return load(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


V0 = "SELECT embedding AS q FROM embeddings WHERE vec_id = 0"
DIST = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))"


def _knn(spark, sf, types=None, k=10):
    e = load(spark, sf, "embeddings")
    return retrieval.knn(e, _vector(spark, sf), k, types, ("vec_id",), "label").select("vec_id", "label", F.round("distance", 6).alias("distance"), T.relevance("distance").alias("relevance"))


KNN = f"SELECT vec_id, label, round(d, 6) AS distance, round(100 * greatest(0.0, least(1.0, 1 - d / 2)), 2) AS relevance FROM (SELECT vec_id, label, {DIST} AS d FROM embeddings, ({V0}) {{}}) ORDER BY d, vec_id LIMIT 10"


@query(KNN.format(""))
def knn_topk(spark, sf):
    return _knn(spark, sf)


@query(KNN.format("WHERE label IN (1, 5)"))
def knn_filtered(spark, sf):
    return _knn(spark, sf, [1, 5])


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, vec_id, round(d, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5")
def knn_batch(spark, sf):
    e = load(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.knn_batch(e, q, 5, "query_id", "vec_id").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


NEAR8 = "q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, label, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d FROM embeddings, q), m AS (SELECT *, round(100 * greatest(0.0, least(1.0, 1 - d / 2)), 2) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d QUALIFY rank <= 8)"


def _matches(spark, sf):
    """The 8 nearest vectors of every vector whose id is divisible by 50, as chunks of documents named by label."""
    e = load(spark, sf, "embeddings")
    near = retrieval.knn_batch(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), retrieval.QA_K, "query_id", "vec_id")
    of = e.select("vec_id", F.col("label").cast("string").alias("source_file"), (F.col("vec_id") % 3).alias("chunk_index"), F.concat(F.lit("S"), (F.col("vec_id") % 2).cast("string")).alias("section_path"))
    return near.join(of, "vec_id").withColumn("relevance", T.relevance("distance"))


@query(f"""WITH {NEAR8}, a AS (SELECT query_id, max(relevance) AS top, list_sort(list(relevance), 'DESC')[2] AS second, count(DISTINCT label) AS sources FROM m GROUP BY 1), g AS (SELECT *, top - second >= 18 AND second > 0 AS conflicting FROM a)
SELECT query_id, top, second, sources, conflicting, top < 58 OR second < 45 OR sources < 2 OR conflicting AS weak,
 CAST(top < 58 AS INT) + CAST(second < 45 AS INT) + CAST(sources < 2 AS INT) + CAST(conflicting AS INT) AS reasons FROM g""")
def evidence(spark, sf):
    return retrieval.evidence(_matches(spark, sf), ("query_id",)).withColumn("reasons", F.size("reasons"))


@query(f"""WITH {NEAR8}, u AS (SELECT query_id, label::VARCHAR AS source_file, concat('S', vec_id % 2) AS section_path, vec_id % 3 AS chunk_index, min(d) AS d FROM m GROUP BY ALL)
SELECT query_id, source_file, section_path, chunk_index, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY source_file, section_path, chunk_index)::INT AS place FROM u""")
def citations(spark, sf):
    return retrieval.citations(_matches(spark, sf), ("query_id",)).withColumn("distance", F.round("distance", 6))


DOC_TYPES = list(retrieval.DOC_TYPES)
ASKED = f"substr(list_extract({DOC_TYPES}, (p_partkey % 13 + 1)::INT), (p_size % 3 + 1)::INT, (p_size % 17 + 1)::INT)"


@query(f"""WITH t AS (SELECT p_partkey, {ASKED} AS v FROM part), k AS (SELECT unnest({DOC_TYPES}) AS n, generate_subscripts({DOC_TYPES}, 1) AS i), m AS (SELECT p_partkey, n, i, levenshtein(n, v) <= 4 AS near, contains(n, v) AS within FROM t, k),
f AS (SELECT p_partkey, bool_or(near) AS has FROM m GROUP BY 1), r AS (SELECT p_partkey, n, i, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rn FROM m JOIN f USING (p_partkey) WHERE CASE WHEN f.has THEN near ELSE within END)
SELECT p_partkey, v AS value, coalesce((SELECT string_agg(n, ',' ORDER BY i) FROM r WHERE r.p_partkey = t.p_partkey AND rn <= 3), '') AS names FROM t""")
def doc_type_suggest(spark, sf):
    known = "array(" + ", ".join(f"'{t}'" for t in DOC_TYPES) + ")"
    asked = F.expr(f"substr(element_at({known}, cast(p_partkey % 13 + 1 as int)), cast(p_size % 3 + 1 as int), cast(p_size % 17 + 1 as int))")
    return load(spark, sf, "part").select("p_partkey", asked.alias("value")).withColumn("names", F.array_join(T.suggest("value", DOC_TYPES), ","))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 25")
def pagination(spark, sf):
    offset = spark.range(1).select(T.decode_cursor(T.encode_cursor(F.lit(25)))).first()[0]
    return retrieval.page(load(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], offset)


@query("""WITH u AS (SELECT conv_id, turn, role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM conversations)
SELECT role AS model, sum(t)::BIGINT AS tokens, round(sum((t * p + t * o) / 1e6), 6) AS cost FROM (SELECT *, CASE role WHEN 'user' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS p, CASE role WHEN 'user' THEN 15.0::DOUBLE ELSE 5.0::DOUBLE END AS o FROM u) GROUP BY 1""")
def usage_cost(spark, sf):
    t = T.estimate_tokens("text")
    u = load(spark, sf, "conversations").select(F.col("role").alias("model"), t.alias("input"), t.alias("output"), F.lit(0).alias("cache_read"), F.lit(0).alias("cache_write"))
    c = incremental.usage_cost(u, spark.createDataFrame([("user", 3.0, 15.0), ("default", 1.0, 5.0)], "model string, price_in double, price_out double"))
    return c.groupBy("model").agg(F.sum("input").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def _session_events(spark, sf):
    return load(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("sequence"), F.when(F.col("role") == "assistant", "final").otherwise("progress").alias("kind"))


@query("SELECT conv_id AS session_id, turn + 1 AS sequence, CASE role WHEN 'assistant' THEN 'final' ELSE 'progress' END AS kind FROM conversations WHERE turn + 1 > 3")
def session_replay(spark, sf):
    return sessions.replay(_session_events(spark, sf), 3)


@query("WITH e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id AS session_id, CASE role WHEN 'assistant' THEN 'completed' ELSE 'active' END AS status, turn + 1 AS last FROM e WHERE k = 1")
def session_state(spark, sf):
    e = _session_events(spark, sf).groupBy("session_id", "sequence").agg(F.max("kind").alias("kind"))
    return sessions.status(e).select("session_id", "status", "last")


@query("SELECT conv_id AS session_id, turn + 1 AS sequence, turn = coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS ok FROM conversations")
def session_gaps(spark, sf):
    return sessions.check_sequence(_session_events(spark, sf)).select("session_id", "sequence", "ok")


#: RE2 has no lookahead: links with a scheme are marked by chr(1), which HTML forbids, while the others are rewritten.
ABROAD = "[a-zA-Z][a-zA-Z0-9+.-]*://"
LINKS = f"""regexp_replace(html, 'href="({ABROAD})', concat('href="', chr(1), '\\1'), 'g')"""
LINKS = f"""regexp_replace({LINKS}, concat('href="([^"', chr(1), '][^"]*)\\.md(#[^"]*)?"'), 'href="\\1.html\\2"', 'g')"""


@query(f"""SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, sha256(replace({LINKS}, concat('href="', chr(1)), 'href="')) AS rewritten FROM pages""")
def html_link_rewrite(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.sha2(T.escape_html("html"), 256).alias("escaped"), F.sha2(T.rewrite_md_links("html"), 256).alias("rewritten"))


@query("SELECT event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS severity, count(*) AS n FROM events GROUP BY ALL ORDER BY severity, event_type")
def severity_report(spark, sf):
    s = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return load(spark, sf, "events").groupBy("event_type", s.alias("severity")).agg(F.count("*").alias("n")).orderBy("severity", "event_type")


@query("SELECT * FROM (SELECT l_suppkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 3")
def top_per_group(spark, sf):
    n = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return facts.per_group(n, 3, ["l_suppkey"], F.desc("n"), "l_partkey")


TEST_PATH = "CASE p_partkey % 6 WHEN 0 THEN concat('src/unit/p', p_partkey, '.ts') WHEN 1 THEN concat('a/integration/p', p_partkey, '.test.ts') WHEN 2 THEN concat('a/e2e/test_p', p_partkey, '.py') WHEN 3 THEN concat('pkg/p', p_partkey, '_test.go') WHEN 4 THEN concat('x/tests/p', p_partkey, '.rs') ELSE concat('contests/p', p_partkey, '.rs') END"


def _tests(spark, sf):
    return load(spark, sf, "part").select(F.expr(TEST_PATH).alias("path"), F.col("p_size").cast("long").alias("tests"))


@query("SELECT CASE p_partkey % 6 WHEN 1 THEN 'vitest' WHEN 2 THEN 'pytest' WHEN 3 THEN 'go_test' ELSE 'rust_test' END AS framework, count(*) AS files, sum(p_size)::BIGINT AS tests FROM part WHERE p_partkey % 6 BETWEEN 1 AND 4 GROUP BY 1")
def tests_by_framework(spark, sf):
    return reports.tests_by_framework(_tests(spark, sf))


@query("SELECT kind, count(*) AS files, sum(p_size)::BIGINT AS tests FROM (SELECT p_size, unnest(CASE p_partkey % 6 WHEN 0 THEN ['unit'] WHEN 1 THEN ['unit', 'integration'] WHEN 2 THEN ['e2e'] ELSE ['other'] END) AS kind FROM part) GROUP BY 1")
def test_kinds(spark, sf):
    return reports.test_kinds(_tests(spark, sf))


SPECIFIER = "concat(CASE l_suppkey % 3 WHEN 0 THEN './' WHEN 1 THEN '@org/' ELSE '' END, 's', l_suppkey)"


def _imports(spark, sf):
    return load(spark, sf, "lineitem").select(F.expr(SPECIFIER).alias("specifier"), F.col("l_orderkey").alias("seq"))


@query("SELECT CASE l_suppkey % 3 WHEN 0 THEN 'relative' WHEN 1 THEN 'scoped-package' ELSE 'package' END AS class, count(*) AS imports FROM lineitem GROUP BY 1")
def import_classes(spark, sf):
    return reports.import_classes(_imports(spark, sf))


@query(f"SELECT {SPECIFIER} AS specifier, count(*) AS imports FROM lineitem GROUP BY 1 ORDER BY imports DESC, min(l_orderkey), specifier LIMIT 20")
def most_imported_top20(spark, sf):
    return reports.most_imported(_imports(spark, sf))


@query(f"SELECT split_part({PATHS}, '/', 1) AS dir, count(*) AS files FROM pages GROUP BY 1 ORDER BY files DESC, dir LIMIT 20")
def files_by_top_dir(spark, sf):
    return reports.files_by_top_dir(load(spark, sf, "pages").select(F.expr(PATHS).alias("path")))


DIRS = "concat('src/', CASE p_size % 5 WHEN 0 THEN 'UserControllers' WHEN 1 THEN 'api-service' WHEN 2 THEN 'plain' WHEN 3 THEN 'eventStore' ELSE 'views/x' END)"


@query(f"SELECT p_partkey, {DIRS} AS path, CASE p_size % 5 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 3 THEN 'store' END AS layer FROM part")
def layer_dirs(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.expr(DIRS).alias("path")).withColumn("layer", reports.layer("path"))


CI_PATH = "CASE p_size % 5 WHEN 0 THEN concat('.github/workflows/p', p_partkey, '.yml') WHEN 1 THEN concat('a', p_partkey, '/jenkinsfile') WHEN 2 THEN concat('p', p_partkey, '/Dockerfile') WHEN 3 THEN concat('p', p_partkey, '/xtravisyml') ELSE concat('p', p_partkey, '/.travis.yml') END"


@query(f"SELECT {CI_PATH} AS path, CASE p_size % 5 WHEN 0 THEN 'GitHub Actions' WHEN 1 THEN 'Jenkins' WHEN 4 THEN 'Travis CI' END AS provider FROM part WHERE p_size % 5 <> 3")
def ci_files(spark, sf):
    return reports.ci_files(load(spark, sf, "part").select(F.expr(CI_PATH).alias("path")))


@query("SELECT variable, count(*) AS refs, array_to_string((list(loc ORDER BY k))[1:3], ',') AS locations FROM (SELECT upper(event_type) AS variable, concat('u', user_id, ':', event_id) AS loc, row_number() OVER (PARTITION BY event_type ORDER BY concat('u', user_id), event_id) AS k FROM events) GROUP BY 1")
def env_locations(spark, sf):
    r = load(spark, sf, "events").select(F.upper("event_type").alias("variable"), F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").alias("line"))
    return reports.locations(r, 3).withColumn("locations", F.array_join("locations", ","))


DOC_FILE = "concat('f', lpad(CAST(event_id AS VARCHAR(20)), 9, '0'), CASE event_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' ELSE '.md' END)"


@query(f"WITH f AS (SELECT {DOC_FILE} AS path, event_id % 4 = 0 AND event_type = 'click' OR event_id % 4 = 2 AND event_type <> 'click' AS has FROM events WHERE event_id % 4 <> 3 ORDER BY path LIMIT 100) SELECT count(*) AS sampled, count(*) FILTER (has) AS documented, CAST(floor(100.0 * count(*) FILTER (has) / count(*) + 0.5) AS INT) AS percent FROM f")
def inline_doc_coverage(spark, sf):
    content = F.when(F.col("event_type") == "click", "/** a\n b */ x").otherwise("/// x")
    return reports.inline_doc_coverage(load(spark, sf, "events").select(F.expr(DOC_FILE).alias("path"), content.alias("content")))


@query("WITH r AS (SELECT turn + 2 AS round, count(*) FILTER (role = 'user') AS v, count(*) FILTER (role <> 'user') AS c FROM conversations GROUP BY 1) SELECT n AS round, CASE WHEN r.round IS NULL THEN 'skipped' ELSE 'success' END AS status, coalesce(v, 0) AS validated, coalesce(c, 0) AS corrected FROM (SELECT unnest(range(1, greatest(6, max(turn) + 2) + 1)) AS n FROM conversations) t LEFT JOIN r ON r.round = n")
def round_table(spark, sf):
    every = load(spark, sf, "conversations")
    rounds = max(6, (every.agg(F.max("turn")).first()[0] or 0) + 2)
    c = every.groupBy((F.col("turn") + 2).alias("round"))
    return reports.round_table(c.agg(F.lit("success").alias("status"), F.count_if(F.col("role") == "user").alias("validated"), F.count_if(F.col("role") != "user").alias("corrected")), rounds)


@query("WITH f AS (SELECT s_nationkey AS module, lower(p_brand) AS pattern, p_partkey AS seq, p_name FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) + 1) SELECT pattern, arg_min(p_name, seq) AS description, concat('Found in ', count(*), ' of ', (SELECT count(DISTINCT module) FROM f), ' modules') AS frequency FROM f GROUP BY 1 HAVING count(*) >= 2")
def cross_cutting_conventions(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("module"))
    p = load(spark, sf, "part").select(F.concat(F.lit("\t "), "p_brand", F.lit(" \n")).alias("pattern"), F.col("p_name").alias("description"), F.col("p_partkey").alias("seq"))
    n = s.agg(F.count("*").alias("n"))
    return reports.conventions(p.crossJoin(F.broadcast(n)).join(s, F.expr("s_suppkey = seq % n + 1")))  # one row


@query("SELECT count(*) FILTER (event_type = 'error') AS critical, count(*) FILTER (event_type = 'signup') AS warning, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS info FROM events")
def edge_case_severities(spark, sf):
    s = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "warning")
    return reports.severities(load(spark, sf, "events").select(s.alias("severity")))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS docs, array_to_string(list_sort(list(DISTINCT lang)), ',') AS types FROM documents")
def index_stats(spark, sf):
    d = load(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("doc_type"))
    return reports.index_stats(d).withColumn("types", F.array_join("types", ","))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 5 THEN 13 * p_size >= 200 AND p_size >= 2 ELSE 13 * p_size >= 500 AND p_size >= 5 END AS acceptable, p_size AS references FROM part")
def round_quality(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", (F.col("p_size") % 6 + 1).alias("round"), F.repeat(F.lit("see a/b.ts . "), F.col("p_size")).alias("text"))
    return reports.quality(p).select("p_partkey", "acceptable", "references")


@query(f"WITH e AS ({NEEDS}) SELECT n_nationkey::BIGINT AS round FROM nation WHERE n_nationkey NOT IN (SELECT b FROM e)")
def terminal_rounds(spark, sf):
    return reports.terminal(load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("round")), _needs(spark, sf).select(F.col("a").alias("round"), F.col("b").alias("needs")))


@query("WITH r AS (SELECT c_nationkey, arg_max(c_mktsegment, c_custkey) AS role FROM customer GROUP BY 1) SELECT s_name AS name, s_nationkey, coalesce(role, '-') AS role, CASE s_suppkey % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'development' ELSE 'peer' END AS section FROM supplier LEFT JOIN r ON c_nationkey = s_nationkey")
def dependency_roles(spark, sf):
    d = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_name").alias("dep"), F.expr("element_at(array('production', 'development', 'peer', 'optional'), cast(s_suppkey % 4 + 1 as int))").alias("type"))
    r = load(spark, sf, "customer").select(F.col("c_nationkey").alias("name"), F.col("c_mktsegment").alias("role"), F.col("c_custkey").alias("seq"))
    return reports.with_role(d, r).select(F.col("dep").alias("name"), F.col("name").alias("s_nationkey"), "role", "section")


@query("SELECT concat('n', p_size) AS path, p_partkey, CASE WHEN p_size < 25 THEN n_name END AS purpose FROM part LEFT JOIN nation ON n_nationkey = p_size")
def directory_annotation(spark, sf):
    modules = load(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.col("n_name").alias("purpose"), F.lit(0).alias("files"))
    return reports.annotated(load(spark, sf, "part").select(F.concat(F.lit("n"), "p_size").alias("path"), "p_partkey"), modules)


@query("SELECT concat('k', p_partkey) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 5 = 1 THEN 'unknown' WHEN p_partkey % 5 = 2 AND p_size <> 7 THEN 'customized' ELSE 'at-default' END AS action FROM part")
def config_diff(spark, sf):
    p = load(spark, sf, "part").select(F.concat(F.lit("k"), "p_partkey").alias("key"), "p_size", (F.col("p_partkey") % 5).alias("m"))
    own = p.filter("m != 0").select("key", F.when(F.col("m") == 2, F.col("p_size")).alias("value"))
    return reports.config_diff(own, p.filter("m != 1").select("key", F.when(F.col("m") == 2, 7).alias("value"))).select("key", "action")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'index' ELSE 'skip' END AS action FROM documents")
def reindex_plan(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", T.document_fingerprint("source", "text").alias("fingerprint"), "source")
    stored = d.filter("source != 'src1'").select("doc_id", F.when(F.col("source") == "src2", "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return reports.reindex_plan(d.select("doc_id", "fingerprint"), stored).select("doc_id", "action")


@query("SELECT p_partkey AS round, p_size % 3 = 0 AND p_partkey % 2 = 0 AS hit FROM part")
def round_cache(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("round"), F.sha2(F.col("p_name"), 256).alias("hash"), "p_size")
    held = p.select("round", F.when(F.col("p_size") % 3 == 0, F.col("hash")).otherwise("other").alias("hash"), (F.col("round") % 2).alias("version"), F.lit("{}").alias("result"))
    return reports.cached_rounds(p.select("round", "hash"), held, 0).select("round", "hit")


@query("SELECT n_name AS doc, array_to_string(list_sort(list(DISTINCT r)), ',') AS rounds FROM (SELECT n_name, unnest([n_regionkey + 1, n_nationkey % 3 + 1]) AS r FROM nation) WHERE r IN (2, 3) GROUP BY 1")
def degraded_docs(spark, sf):
    docs = load(spark, sf, "nation").select(F.col("n_name").alias("doc"), F.array(F.col("n_regionkey") + 1, F.col("n_nationkey") % 3 + 1).alias("rounds"))
    return reports.affected_by(spark.createDataFrame([(2,), (3,)], "round int"), docs).withColumn("rounds", F.array_join("rounds", ","))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
