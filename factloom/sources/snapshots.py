"""Small states kept as JSON, tables kept with their metadata, and resources that are read by name."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value) -> None:
    """The value as JSON in one file, which readers see whole or not at all: written beside, then renamed."""
    p, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot rename {beside} to {p}")


def read_json(spark: SparkSession, path: str, version=None, key: str = "version"):
    """The value of such a file, None if it is missing, broken or of another version; then everything runs anew."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    found = spark.read.text(path, wholetext=True).first()
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return value if version is None or isinstance(value, dict) and value.get(key) == version else None


def key_values(rows: DataFrame) -> dict[str, str]:
    """Metadata rows(key, value) as a dictionary; of a repeated key the last value in order."""
    got = rows.groupBy("key").agg(F.max("value").alias("value")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value")))).first()
    return dict(got[0] or {})


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A table under Spark's commit protocol; by: a column whose partitions are replaced and the others kept."""
    out = df.write.mode("overwrite")
    if by:
        out = out.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


class Catalog:
    """Resources by address, each with a title, a kind and how to read it."""

    def __init__(self, scheme: str = "factloom"):
        self.scheme, self.entries = scheme, {}

    def add(self, kind: str, name: str, title: str, mime: str, read: Callable[[], str], description: str = "") -> None:
        uri = f"{self.scheme}://{kind}/{name}"
        self.entries[uri] = {"uri": uri, "name": name, "title": title, "mime": mime, "description": description, "read": read}

    def add_documents(self, documents: DataFrame) -> None:
        """Documents (doc_id, title, source_file, content): listed by name, read when asked for."""
        for r in documents.select("doc_id", "title", "source_file").collect():  # a row for each of a project's documents
            self.add("docs", r["doc_id"], r["title"], "text/markdown", lambda i=r["doc_id"]: documents.filter(F.col("doc_id") == i).select("content").first()[0], r["source_file"])

    def add_analysis(self, name: str, title: str, facts: DataFrame, most: int = 10_000) -> None:
        """A table of facts as JSON, whole; ValueError beyond `most` rows, as a resource is one text."""
        def read():
            rows = facts.limit(most + 1).toJSON().collect()
            if len(rows) > most:
                raise ValueError(f"{name} has more than {most} rows")
            return "[" + ",".join(rows) + "]"

        self.add("analysis", name, title, "application/json", read)

    def listed(self) -> list[dict]:
        return [{k: v for k, v in e.items() if k != "read"} for e in sorted(self.entries.values(), key=lambda e: (e["uri"], e["title"]))]

    def page(self, cursor: int = 0, limit: int = 25, most: int = 50) -> tuple[list[dict], int | None]:
        """A page and where the next begins."""
        size, every = max(1, min(most, limit)), self.listed()
        end = cursor + size
        return every[cursor:end], end if end < len(every) else None

    def read(self, uri: str) -> dict:
        """The resource, or an error that lists the addresses that exist."""
        e = self.entries.get(uri)
        if e is None:
            return {"uri": uri, "error": "RESOURCE_NOT_FOUND", "available": [x["uri"] for x in self.listed()]}
        return {"uri": uri, "mime": e["mime"], "text": e["read"]()}
