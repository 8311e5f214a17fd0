"""An index of chunks that follows its documents: only what changed is cut and embedded again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import chunks, reports, retrieval

CHUNKS = "doc_id string, doc_type string, source_file string, chunk_index int, section_path string, h1 string, h2 string, h3 string, token_count int, content_preview string, content string, embedding array<float>"
PRINTS = "doc_id string, fingerprint string, chunk_count long"
#: Fixed value: version of the index's layout.
VERSION = "1"


class Index(NamedTuple):
    chunks: DataFrame
    prints: DataFrame
    meta: dict[str, str]  #: version, model and dimensions


def new(spark: SparkSession, model: str, dims: int) -> Index:
    return Index(spark.createDataFrame([], CHUNKS), spark.createDataFrame([], PRINTS), {"schema_version": VERSION, "embedding_model": model, "embedding_dimensions": str(dims)})


def stored(meta: dict[str, str] | None) -> tuple[str, int] | None:
    """V3: model and dimensions of an index, None if it has none."""
    if not meta or not meta.get("embedding_model") or not meta.get("embedding_dimensions"):
        return None
    return meta["embedding_model"], int(meta["embedding_dimensions"])


def fingerprints(docs: DataFrame, index: Index) -> DataFrame:
    """Documents with the fingerprint that the index holds of them, by one join."""
    return docs.join(index.prints.select("doc_id", F.col("fingerprint").alias("stored")), "doc_id", "left")


def embedded(cut: DataFrame, embed, dims: int) -> DataFrame:
    """Chunks with their vectors by their key. embed(rows(key, content)) gives (key, embedding); a chunk without a
    vector of the right length does not enter the index."""
    keyed = cut.withColumn("key", F.concat_ws("#", "doc_id", F.col("chunk_index").cast("string")))
    vectors = embed(keyed.select("key", "content")).select("key", F.col("embedding").cast("array<float>").alias("embedding"))
    return keyed.join(vectors.filter(F.size("embedding") == dims), "key").drop("key")


def changes(docs: DataFrame, prints: DataFrame, embed, dims: int, force: bool = False, keep=lambda df, name: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What reindexing docs(doc_id, doc_type, source_file, content) changes: one row per document with its action and
    number of chunks, the prints of those that were indexed, and their chunks with vectors. keep(table, name) may write what
    is used more than once, so that nothing is embedded twice."""
    now = docs.withColumn("fingerprint", T.document_fingerprint("source_file", "content"))
    plan = keep(reports.reindex_plan(now, prints.select("doc_id", "fingerprint"), force).select("doc_id", "fingerprint", "action"), "plan")
    cut = keep(chunks.chunk(docs.join(plan.filter("action = 'index'").select("doc_id"), "doc_id", "left_semi")), "cut")
    found = keep(embedded(cut, embed, dims), "found")
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    outcome = plan.join(n(cut, "chunks"), "doc_id", "left").join(n(found, "vectors"), "doc_id", "left")
    whole = F.coalesce("chunks", F.lit(0)) == F.coalesce("vectors", F.lit(0))
    outcome = outcome.withColumn("action", F.when((F.col("action") == "index") & ~whole, "failed").otherwise(F.col("action")))
    done = outcome.filter("action = 'index'").select("doc_id", "fingerprint", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunk_count"))
    return outcome.select("doc_id", "action", F.coalesce("chunks", F.lit(0)).alias("chunks")), done, found.join(done.select("doc_id"), "doc_id", "left_semi")


def reindex(docs: DataFrame, index: Index, embed, model: str, dims: int, force: bool = False) -> tuple[Index, DataFrame]:
    """The index of docs(doc_id, doc_type, source_file, content), and one row per document with whether it was
    indexed, skipped or failed and its number of chunks. `disk_index` keeps it between runs.

    Changed documents' old chunks go and their new ones enter together; documents that are no longer there keep theirs.
    A document fails if one of its chunks has no vector; then its old chunks and fingerprint stay. Documents of blank text
    are indexed with no chunk.
    """
    retrieval.check_index(stored(index.meta), model, dims, writing=True)
    outcome, done, fresh = changes(docs, index.prints, embed, dims, force)
    table = index.chunks.join(done.select("doc_id"), "doc_id", "left_anti").unionByName(fresh.select(*index.chunks.columns))
    return Index(table.select(*index.chunks.columns), retrieval.upsert(index.prints, done, ["doc_id"]), index.meta | {"embedding_model": model}), outcome


def summary(outcome: DataFrame) -> DataFrame:
    """One row: documents indexed, skipped and failed, and chunks made."""
    count = lambda a: F.count_if(F.col("action") == a)
    return outcome.agg(count("index").alias("processed"), count("skip").alias("skipped"), count("failed").alias("failed"), F.count("*").alias("total"), F.coalesce(F.sum(F.when(F.col("action") == "index", F.col("chunks"))), F.lit(0)).alias("chunks"))
