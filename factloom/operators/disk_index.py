"""The index of chunks on disk: versions of buckets, and manifests that name the buckets of each version.

A document belongs to a bucket by its id. A run writes the buckets of changed documents anew, into a folder of its own, and
then a manifest that takes these and, for all other buckets, what the manifest before it names. Readers follow one manifest,
so they see one version whole; a run that dies before its manifest leaves files that nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import reindex, retrieval
from factloom.operators.written import Work
from factloom.sources import snapshots

TABLES = {"chunks": reindex.CHUNKS, "prints": reindex.PRINTS}


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = snapshots._fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version: version, meta, buckets in all, and the version of each bucket of each
    table; None if there is none."""
    found = [int(n[:-5]) for n in _names(spark, f"{root}/manifest") if n.endswith(".json")]
    chosen = max(found, default=None) if version is None else version if version in found else None
    return None if chosen is None else snapshots.read_json(spark, f"{root}/manifest/{chosen:010d}.json")


def publish(spark: SparkSession, root: str, new: dict) -> None:
    """Makes a version the newest. RuntimeError if another run has published one of its number."""
    path = f"{root}/manifest/{new['version']:010d}.json"
    p, fs = snapshots._fs(spark, path)
    if fs.exists(p):
        raise RuntimeError(f"version {new['version']} is there already: another run wrote the index meanwhile")
    snapshots.write_json(spark, path, new)


def _table(spark: SparkSession, root: str, name: str, of: dict[str, int]) -> DataFrame:
    paths = [f"{root}/{name}/version={v}/bucket={b}" for b, v in sorted(of.items())]
    return spark.read.schema(TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name])


def read(spark: SparkSession, root: str, version: int | None = None) -> reindex.Index | None:
    """The index as of a version, the newest by default; None if there is none."""
    m = manifest(spark, root, version)
    return m and reindex.Index(*(_table(spark, root, t, m[t]) for t in TABLES), m["meta"])


def bucket(doc_id, buckets: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def lookup(spark: SparkSession, root: str, doc_ids: list[str], table: str = "chunks") -> DataFrame:
    """Rows of a few documents, from their buckets alone."""
    m = manifest(spark, root)
    if not m or not doc_ids:
        return spark.createDataFrame([], TABLES[table])
    ids = spark.createDataFrame([(i,) for i in doc_ids], "doc_id string")
    wanted = {str(r[0]) for r in ids.select(bucket("doc_id", m["buckets"])).distinct().collect()}  # as many as ids that the caller holds
    return _table(spark, root, table, {b: v for b, v in m[table].items() if b in wanted}).join(F.broadcast(ids), "doc_id", "left_semi")


def update(docs: DataFrame, root: str, embed, model: str, dims: int, buckets: int = 64, force: bool = False) -> DataFrame:
    """Reindexes docs into the index below root and gives one row per document with what became of it.

    docs(doc_id, doc_type, source_file, content), embed and failures as in `reindex.reindex`. Only buckets of documents that
    were indexed are read and written; without such documents there is no new version. `buckets` counts when the index is
    made and holds from then on: choose it so that a bucket fits a task. IndexError of another model or size: see `check_index`.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "reindex")
    old = manifest(spark, root) or {"version": 0, "meta": {"schema_version": reindex.VERSION, "embedding_model": model, "embedding_dimensions": str(dims)}, "buckets": buckets, **{t: {} for t in TABLES}}
    retrieval.check_index(reindex.stored(old["meta"]), model, dims, writing=True)
    outcome, done, fresh = reindex.changes(docs, _table(spark, root, "prints", old["prints"]), embed, dims, force, work.table)
    done, of, version = work.table(done, "done"), lambda c: bucket(c, old["buckets"]), old["version"] + 1
    outcome = work.table(outcome, "outcome")
    touched = {str(r[0]) for r in done.select(of("doc_id")).distinct().collect()}  # as many as buckets at most
    if touched:
        new = old | {"version": version}
        for name, rows in (("chunks", fresh), ("prints", done)):
            kept = _table(spark, root, name, {b: v for b, v in old[name].items() if b in touched})
            table = kept.join(done.select("doc_id"), "doc_id", "left_anti").unionByName(rows.select(*kept.columns)).withColumn("bucket", of("doc_id"))
            table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/version={version}")
            written = {n.partition("=")[2]: version for n in _names(spark, f"{root}/{name}/version={version}") if n.startswith("bucket=")}
            new[name] = {b: v for b, v in old[name].items() if b not in touched} | written
        publish(spark, root, new)
    return outcome


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes manifests but the newest few, and folders of buckets that none of those names; gives what went."""
    names = [n for n in _names(spark, f"{root}/manifest") if n.endswith(".json")]
    left = [snapshots.read_json(spark, f"{root}/manifest/{n}") for n in names[-keep:]]
    gone = [f"manifest/{n}" for n in names[:-keep]]
    for name in TABLES:
        used = {f"version={v}/bucket={b}" for m in left for b, v in m[name].items()}
        for v in _names(spark, f"{root}/{name}"):
            gone += [f"{name}/{v}/{b}" for b in _names(spark, f"{root}/{name}/{v}") if b.startswith("bucket=") and f"{v}/{b}" not in used]
    for path in gone:
        p, fs = snapshots._fs(spark, f"{root}/{path}")
        fs.delete(p, True)
    return gone
