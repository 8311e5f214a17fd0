"""The ten operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import embed_dedup, exact_dedup, html_layout, lattice, minhash, mixing, name_join, pieces, ranked, repeats, sharding, toxicity, warc
from factloom.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = Scratch(spark, "warc").path("archives")
    warc.write(pages, path)
    records = warc.read(spark, path)
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+|null):", 1).try_cast("long")
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


def op2_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs))
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.expr("decoded <=> text").alias("round_trip"))


def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out, stats = mixing.mix(docs, F.array(F.col("source")), payload=["source"])
    listed = spark.createDataFrame([(s, int(n), float(t)) for s, (n, t) in stats.items()], "s string, source_size long, target double")  # a row for each source
    return out.join(F.broadcast(listed), F.expr("source <=> s")).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op4_lattice(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents").select("doc_id", "text"), learn=True)


def op5_html(spark, sf_dir):
    return html_layout.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op9_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_minhash(spark, sf_dir):
    return minhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def misspelt(vendor_id, name):
    """The stored name with two neighbours exchanged, by the crc32 of the id; as it is where that is odd or the name short."""
    h, n = F.crc32(vendor_id.cast("string").cast("binary")), F.length(name)
    i = (h % (n - 1)).cast("int")
    part = lambda start, length: F.substring(name, start, length)
    swapped = F.concat(part(F.lit(1), i), part(i + 2, F.lit(1)), part(i + 1, F.lit(1)), part(i + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def op11_name_join(spark, sf_dir):
    scratch = Scratch(spark, "op11")
    clients = table(spark, sf_dir, "clients").select("client_id", name_join.plain(F.col("name")).alias("name")).filter("name != ''")
    clients = clients.groupBy("name").agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))).alias("crc"))
    clients = scratch.table(clients, "clients")
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", name_join.plain(misspelt(F.col("vendor_id"), F.col("name"))).alias("left_name"))
    vendors = scratch.table(vendors.filter("left_name != ''"), "vendors")
    pairs = name_join.join_names(vendors.select("left_name"), clients.select("name"), 1)
    found = pairs.join(clients.withColumnRenamed("name", "right_name").hint("merge"), "right_name").groupBy("left_name", "distance")
    found = found.agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
    found = scratch.table(found, "found")  # written, so that the join below can split a name of any number of vendors
    return vendors.join(found.hint("merge"), "left_name").select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")


def op12_substring_dedup(spark, sf_dir):
    out = repeats.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def queries():
    return {f.__name__: f for f in (op1_warc, op2_sentencepiece, op3_mixing, op4_lattice, op5_html, op6_exact_dedup, op7_embedding_dedup, op8_toxicity, op9_sharding, op10_minhash, op11_name_join, op12_substring_dedup, op13_ranked_search)}


OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, payload FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY payload) AS first FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(h, CAST(i // 8 * 10 + 1 AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first END AS refers_to
FROM f
"""

OP6 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n_cp DESC, doc_id) AS k, count(*) OVER (PARTITION BY t) AS group_size,
  first_value(doc_id) OVER (PARTITION BY t ORDER BY n_cp DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM k
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON m.v = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT m.v AS doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.v = m.c AS kept FROM m LEFT JOIN n ON n.doc_id = m.v
"""


#: crc32 by its table of 256 entries; `tab` has them as one list.
CRC = """
steps(i, n, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE n = 8)"""


def crc(text: str) -> str:
    """SQL for the unsigned crc32 of a text of ASCII characters, where `tab` is in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = rf"""
WITH RECURSIVE {CRC.strip()},
c AS (SELECT client_id, translate(regexp_replace(name, '[\x20\x09-\x0D]+', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS y, {crc("client_id::VARCHAR")} AS crc FROM clients, tab),
cn AS (SELECT y, count(*) AS n, min(client_id) AS first, sum(crc) AS crc FROM c WHERE y <> '' GROUP BY y),
h AS (SELECT vendor_id, name, length(name) AS n, {crc("vendor_id::VARCHAR")} AS h FROM vendors, tab),
m AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND n >= 2 THEN substr(name, 1, h % (n - 1)) || substr(name, h % (n - 1) + 2, 1) || substr(name, h % (n - 1) + 1, 1) || substr(name, h % (n - 1) + 3) ELSE name END AS name FROM h),
v AS (SELECT vendor_id, translate(regexp_replace(name, '[\x20\x09-\x0D]+', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM m),
p AS (SELECT vendor_id, x, y, n, first, crc, list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1)) AS dif
  FROM v JOIN cn ON x <> '' AND abs(length(x) - length(y)) <= 1),
d AS (SELECT *, CASE WHEN x = y THEN 0
  WHEN length(x) = length(y) THEN CASE WHEN len(dif) = 1 OR len(dif) = 2 AND dif[2] = dif[1] + 1 AND substr(x, dif[1], 1) = substr(y, dif[2], 1) AND substr(x, dif[2], 1) = substr(y, dif[1], 1) THEN 1 END
  WHEN length(x) > length(y) THEN CASE WHEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1) = y)) > 0 THEN 1 END
  WHEN len(list_filter(range(1, length(y) + 1), lambda i: substr(y, 1, i - 1) || substr(y, i + 1) = x)) > 0 THEN 1 END AS distance FROM p)
SELECT vendor_id, distance::INT AS distance, sum(n)::BIGINT AS n_clients, min(first) AS first_client_id, sum(crc)::BIGINT AS clients_crc FROM d WHERE distance IS NOT NULL GROUP BY vendor_id, x, distance
"""


OP12 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 's': list_aggregate(w[i:i+12], 'string_agg', ' ')})) AS g FROM w WHERE len(w) >= 13),
f AS (SELECT doc_id, g.i AS i, min(doc_id) OVER (PARTITION BY g.s) AS first FROM g),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM f, range(13) AS r(o) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(list_aggregate(list_transform(list_filter(range(1, len(w.w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: w.w[i]), 'string_agg', ' '), '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""


OP13 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT doc_id, d, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
c AS (SELECT doc_id, d, term, count(*) AS tf FROM p GROUP BY doc_id, d, term),
f AS (SELECT *, (sum(tf) OVER (PARTITION BY d))::BIGINT AS n FROM c),
g AS (SELECT count(DISTINCT d) AS nn, sum(tf)::BIGINT AS l FROM f),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term), g GROUP BY item_id, d, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def oracle_sql():
    return {"op1_warc": OP1, "op6_exact_dedup": OP6, "op7_embedding_dedup": OP7, "op10_minhash": OP10, "op11_name_join": OP11, "op12_substring_dedup": OP12, "op13_ranked_search": OP13}
