"""Queries of functions, predicates, sources of text, states and costs, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import facts, graph, incremental, predicates, rounds
from factloom.plans.catalog import PATHS, load, query
from factloom.sources import files, settings


def text_of(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("SELECT concat('h', o_orderkey) AS hash, concat('a', o_custkey) AS author, concat('a', o_custkey, '@x.org') AS email, concat('2024-', 1 + o_orderkey % 12) AS date, concat(o_orderpriority, '|', o_orderstatus, '|') AS message FROM orders")
def git_log_rows(spark, sf):
    o = load(spark, sf, "orders")
    who = text_of("a", F.col("o_custkey"))
    line = F.concat_ws("|", text_of("h", F.col("o_orderkey")), who, F.concat(who, F.lit("@x.org")), text_of("2024-", 1 + F.col("o_orderkey") % 12), F.concat("o_orderpriority", F.lit("|"), "o_orderstatus", F.lit("|")))
    return files.git_log(o.select(F.explode(F.array(line, F.lit(""))).alias("value")))


@query("SELECT concat(CASE o_orderkey % 3 WHEN 0 THEN 'feature/' WHEN 1 THEN 'release-' ELSE '' END, o_orderkey) AS name, o_orderdate AS commit_ts FROM orders")
def git_ref_rows(spark, sf):
    name = F.concat(F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'feature/' WHEN 1 THEN 'release-' ELSE '' END"), F.col("o_orderkey").cast("string"))
    return files.git_refs(load(spark, sf, "orders").select(F.concat_ws("|", name, F.col("o_orderdate").cast("string")).alias("value")))


@query("SELECT concat('h', l_orderkey) AS hash, concat('p', l_partkey, '.ts') AS path FROM lineitem WHERE l_linenumber <> 3")
def git_name_rows(spark, sf):
    value = F.when(F.col("l_linenumber") == 3, "  ").otherwise(F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit(".ts ")))
    return settings.files_of_commits(load(spark, sf, "lineitem").select(text_of("h", F.col("l_orderkey")).alias("hash"), value.alias("value")))


@query("SELECT concat('p', l_partkey) AS path FROM lineitem UNION SELECT concat('p', p_partkey) FROM part UNION SELECT concat('p', s_suppkey) FROM supplier")
def changed_paths(spark, sf):
    parts = (("lineitem", "l_partkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))
    return files.change_set([load(spark, sf, t).select(text_of("p", F.col(c)).alias("path"), F.lit(t).alias("state")) for t, c in parts])


ENV_LINE = "CASE event_id % 4 WHEN 0 THEN concat('  ', upper(event_type), '=', value) WHEN 1 THEN concat(event_type, '=1') WHEN 2 THEN concat('# ', upper(event_type), '=') ELSE concat('_', upper(event_type), event_id % 7, '=') END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 3 THEN concat('_', upper(event_type), event_id % 7) END AS variable FROM events")
def env_file_lines(spark, sf):
    return load(spark, sf, "events").select("event_id", T.env_file_var(F.expr(ENV_LINE)).alias("variable"))


#: Paths of pages under names that predicates know or almost know.
NAMED = f"concat(CASE page_id % 4 WHEN 0 THEN 'docs/' WHEN 1 THEN 'src/utils/' WHEN 2 THEN '' ELSE 'a/doc/' END, CASE page_id % 11 WHEN 0 THEN 'README.md' WHEN 1 THEN 'readme' WHEN 2 THEN 'go.mod' WHEN 3 THEN '.env.local' WHEN 4 THEN 'x.env' WHEN 5 THEN 'Notes.RST' WHEN 6 THEN 'types.ts' WHEN 7 THEN 'package.json' WHEN 8 THEN 'readmes.md' WHEN 9 THEN 'my.go.mod' ELSE regexp_replace({PATHS}, '^.*/', '') END)"


@query(f"SELECT page_id, regexp_replace(p, '^.*/', '') IN ('package.json', 'Cargo.toml', 'go.mod', 'requirements.txt', 'pyproject.toml') AS manifest, starts_with(regexp_replace(p, '^.*/', ''), '.env') AS env, regexp_matches(lower(regexp_replace(p, '^.*/', '')), '^readme([.](md|txt|rst|adoc))?$') AS readme, starts_with(p, 'src/utils/') OR ends_with(p, '/types.ts') OR p = 'types.ts' AS infrastructure FROM (SELECT page_id, {NAMED} AS p FROM pages)")
def file_classes(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.expr(NAMED).alias("p"))
    return p.select("page_id", predicates.is_manifest("p").alias("manifest"), predicates.is_env_file("p").alias("env"), predicates.is_readme("p").alias("readme"), predicates.is_infrastructure("p").alias("infrastructure"))


@query(f"WITH p AS (SELECT page_id, {NAMED} AS path FROM pages), f AS (SELECT split_part(path, '/', 1) AS folder FROM p WHERE contains(path, '/') AND split_part(path, '/', 1) IN ('docs', 'doc', 'documentation', 'wiki', '.github') ORDER BY path LIMIT 1) SELECT page_id, path FROM p WHERE split_part(path, '/', 1) = (SELECT folder FROM f) OR regexp_matches(lower(regexp_replace(path, '^.*/', '')), '.[.](md|txt|rst|adoc)$')")
def doc_files(spark, sf):
    return predicates.doc_files(load(spark, sf, "pages").select("page_id", F.expr(NAMED).alias("path")))


@query("""SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN concat(strlen(text), ' B') ELSE printf('%.1f KB', strlen(text) / 1024.0 + CASE WHEN strlen(text) % 512 = 256 THEN 0.01 ELSE 0 END) END AS size, CASE WHEN n_chars >= 1000 THEN concat(CASE WHEN n_chars % 1000 = 0 THEN (n_chars // 1000)::VARCHAR ELSE printf('%.1f', n_chars / 1000.0::DOUBLE + CASE WHEN n_chars % 500 = 250 THEN 0.01 ELSE 0 END) END, 'K tokens') ELSE concat(n_chars, ' tokens') END AS tokens,
CASE WHEN n_chars // 10 < 60 THEN concat(n_chars // 10, 's') ELSE concat(n_chars // 600, 'm ', n_chars // 10 % 60, 's') END AS took, CASE WHEN n_chars < 50 THEN 'small' WHEN n_chars < 200 THEN 'medium' ELSE 'large' END AS complexity, concat(repeat('=', least(20, n_chars // 100)::INT), repeat('-', (20 - least(20, n_chars // 100))::INT)) AS bar FROM documents""")
def formatted_sizes(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", T.human_size(F.octet_length("text").cast("long")).alias("size"), T.short_count("n_chars").alias("tokens"), T.duration(F.col("n_chars") * 100).alias("took"), T.complexity("n_chars").alias("complexity"), T.bar(F.floor(F.col("n_chars") / 100), F.lit(20), plain=True).alias("bar"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN concat(left(text, 37), '...') ELSE text END AS short, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS one_line, regexp_replace(regexp_replace(translate(lower(left(text, 60)), chr(10) || chr(9), ''), '[^a-z0-9 -]', '', 'g'), ' +', '-', 'g') AS anchor FROM conversations")
def shortened_texts(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.truncate("text", 40).alias("short"), T.content_hash(T.one_line("text")).alias("one_line"), T.anchor(F.left("text", F.lit(60))).alias("anchor"))


@query("SELECT p_partkey, concat('`p', p_partkey, '/x.ts:L', p_size, '`') AS code, concat('[', 'Brand Part', '](', lpad(p_size::VARCHAR, 2, '0'), '-brand-part.md#s', p_size, ')') AS link, concat('| ', p_name, ' | ', p_brand, '\\|', p_type, ' |') AS row FROM part")
def references_written(spark, sf):
    p = load(spark, sf, "part")
    doc = p.select("*", F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-brand-part")).alias("doc"), text_of("s", F.col("p_size")).alias("at"), text_of("./p", F.col("p_partkey"), "/x.ts").alias("path"), F.concat("p_brand", F.lit("|"), "p_type").alias("kind"))
    return doc.select("p_partkey", T.code_ref("path", "p_size").alias("code"), T.cross_ref("doc", "at").alias("link"), T.table_row(["p_name", "kind"]).alias("row"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('src/a', conv_id, '.ts') WHEN turn % 3 = 1 THEN concat('lib/m', turn, '.py src/a', conv_id, '.ts') ELSE '' END AS claims FROM conversations")
def claims_in_texts(spark, sf):
    a, m = text_of("src/a", F.col("conv_id"), ".ts"), text_of("lib/m", F.col("turn"), ".py")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("see `"), a, F.lit("`, ("), a, F.lit(") and b.ts: "), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit(' ["'), a, F.lit('",'), m, F.lit("]"))).otherwise(F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(T.path_claims(said)), " ").alias("claims"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS since, o_orderdate + INTERVAL 90 MINUTE AS ends, round(1000 * 2 ** (o_orderkey % 5) * (0.5 + (o_orderkey % 10) / 10.0), 6)::DOUBLE AS wait FROM orders")
def times_of_orders(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", T.six_months_before("o_orderdate").cast("timestamp_ntz").alias("since"), T.expires("o_orderdate", 90 * 60_000).alias("ends"), F.round(T.backoff(F.lit(1000), F.col("o_orderkey") % 5, (F.col("o_orderkey") % 10) / 10.0), 6).alias("wait"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN round(c_custkey % 3 * 1000 * 3.0 * 0.9 / 1e6, 9)::DOUBLE ELSE -1 END AS saved, CASE WHEN c_custkey % 3 > 0 THEN round(100.0 * (c_custkey % 3 * 1000) / (c_custkey + c_custkey % 3 * 1000 + 10), 9)::DOUBLE ELSE -1 END AS share FROM customer")
def cache_savings(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3 * 1000).alias("read"), F.col("c_custkey").cast("double").alias("inp"), F.lit(10).alias("written"), F.lit(3.0).alias("price"))
    return c.select("c_custkey", F.coalesce(F.round(T.cache_saving("read", "price"), 9), F.lit(-1.0)).alias("saved"), F.coalesce(F.round(T.cache_share("inp", "read", "written"), 9), F.lit(-1.0)).alias("share"))


COSTS = "SELECT s_suppkey, s_nationkey % 4 = 0 AS local, CASE WHEN s_nationkey % 4 = 0 THEN 0 ELSE 5e6 / 1e6 * s_nationkey + 5e6 * 0.2 / 1e6 * (s_nationkey * 4) END AS cost FROM supplier"


@query(f"SELECT concat('s', s_suppkey) AS provider, round(cost, 6)::DOUBLE AS cost, row_number() OVER (ORDER BY s_suppkey = 3 DESC, local, cost, concat('s', s_suppkey))::INT AS place FROM ({COSTS})")
def provider_costs(spark, sf):
    s = load(spark, sf, "supplier").select(text_of("s", F.col("s_suppkey")).alias("provider"), F.lit("m").alias("model"), (F.col("s_nationkey") % 4 == 0).alias("local"), F.col("s_nationkey").cast("double").alias("price_in"), (F.col("s_nationkey") * 4).cast("double").alias("price_out"))
    return rounds.cost_estimates(F.lit(5_000_000), s, "s3").select("provider", F.round("cost", 6).alias("cost"), "place")


@query("SELECT date_part('year', o_orderdate)::INT AS year, date_part('month', o_orderdate)::INT AS month, count(*) AS commits FROM orders GROUP BY 1, 2")
def commits_by_month(spark, sf):
    m = facts.months(load(spark, sf, "orders").select(F.col("o_orderdate").alias("date")))
    return m.select(F.split("month", "-")[0].cast("int").alias("year"), F.split("month", "-")[1].cast("int").alias("month"), "commits")


@query("SELECT count(*) FILTER (event_type IN ('click', 'view')) AS succeeded, count(*) FILTER (event_type = 'error') AS degraded, count(*) FILTER (event_type = 'signup') AS skipped, count(*) AS rounds, sum(event_id % 7)::BIGINT AS validated, sum(event_id % 3)::BIGINT AS corrected FROM events")
def failures_by_status(spark, sf):
    status = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "view", "retried").when(F.col("event_type") == "error", "degraded").when(F.col("event_type") == "signup", "skipped").otherwise("running")
    return rounds.failure_counts(load(spark, sf, "events").select(status.alias("status"), (F.col("event_id") % 7).alias("validated"), (F.col("event_id") % 3).alias("corrected")))


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def remarks_as_edge_cases(spark, sf):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "bugs").when(F.col("c_mktsegment") == "MACHINERY", "debt").otherwise("notes")
    return predicates.edge_remarks(load(spark, sf, "customer").withColumn("category", kind)).select("c_custkey", F.col("c_mktsegment").alias("segment"))


@query("SELECT o_orderkey, 'required' AS kind FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'optional' FROM orders WHERE o_orderstatus <> 'O'")
def variables_required(spark, sf):
    v = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("required"))
    return predicates.required(v).select("o_orderkey", F.lit("required").alias("kind")).unionByName(predicates.required(v, False).select("o_orderkey", F.lit("optional").alias("kind")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'")
def packed_for_prompts(spark, sf):
    return predicates.included(load(spark, sf, "lineitem").withColumn("tier", F.when(F.col("l_returnflag") == "N", "skip").otherwise("full"))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'generated' ELSE 'source' END AS side FROM orders")
def changes_by_output(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 5 == 0, "out/").otherwise("outer/"), F.col("o_orderkey").cast("string")).alias("path"))
    sources, made = predicates.by_output(o, "out")
    return sources.select("o_orderkey", F.lit("source").alias("side")).unionByName(made.select("o_orderkey", F.lit("generated").alias("side")))


@query("WITH e AS (SELECT DISTINCT l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem) SELECT o_orderkey, (SELECT count(*) FROM e WHERE (a, b) IN ((o_orderkey % 61, o_custkey % 61), (o_custkey % 61, o_orderkey % 61))) > 0 AS held FROM orders")
def links_claimed(spark, sf):
    edges = load(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"))
    claims = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 61).alias("a"), (F.col("o_custkey") % 61).alias("b"))
    return graph.connected(claims, edges).select("o_orderkey", "held")


@query("SELECT concat('r', n_nationkey) AS renderer, CASE WHEN n_nationkey = 7 OR n_regionkey IN (1, 2) THEN 'execute' ELSE 'skip' END AS decision FROM nation")
def dry_run_decisions(spark, sf):
    n = load(spark, sf, "nation").select(text_of("r", F.col("n_nationkey")).alias("renderer"), "n_regionkey", F.col("n_name").alias("path"))
    hit, unclaimed = incremental.affected(n.filter("n_regionkey in (1, 2)").select("path"), n.select("renderer", "path"), n.limit(0).select("path"))
    return incremental.dry_run(n.select("renderer"), hit, unclaimed, "r7")


@query("SELECT s_suppkey, s_nationkey % 3 > 0 AND s_suppkey % 4 > 0 AS reused FROM supplier")
def outputs_reused(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", text_of("n", F.col("s_nationkey")).alias("renderer"), text_of("f", F.col("s_suppkey")).alias("filename"), "s_nationkey")
    return settings.reused(s.drop("s_nationkey"), s.filter("s_nationkey % 3 = 0").select("renderer"), s.filter("s_suppkey % 4 > 0").select("filename")).select("s_suppkey", "reused")
