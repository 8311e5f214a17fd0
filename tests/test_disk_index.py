"""The index on disk: only buckets of changed documents are written, and a version is seen whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import disk_index as D

KIND = "doc_id string, doc_type string, source_file string, content string"


def vectors(rows):
    return rows.select("key", F.when(~F.contains("content", F.lit("broken")), F.array(F.length("content").cast("float"), F.lit(1.0).cast("float"))).alias("embedding"))


@pytest.fixture
def docs(spark):
    return lambda change=None: spark.createDataFrame([(f"d{i}", "t", f"d{i}.md", (change or {}).get(i, f"# Head {i}\n\nbody {i}\n\n## Sub\n\nmore")) for i in range(40)] + [("blank", "t", "blank.md", " \n")], KIND)


def files(root):
    return {os.path.relpath(f"{d}/{x}", root) for d, _, names in os.walk(root) for x in names if x.endswith((".parquet", ".json"))}


def texts(index):
    return sorted(map(tuple, index.chunks.select("doc_id", "chunk_index", "content").collect()))


def test_two_runs(spark, tmp_path, docs):
    root = str(tmp_path / "index")
    assert D.read(spark, root) is None
    assert D.lookup(spark, root, ["d1"]).count() == 0
    first = D.update(docs(), root, vectors, "m", 2, buckets=16)
    assert {r.action for r in first.collect()} == {"index"}
    before, seen = files(root), texts(D.read(spark, root))
    assert len(seen) == 80
    assert D.read(spark, root).prints.count() == 41
    assert {r.action for r in D.update(docs(), root, vectors, "m", 2).collect()} == {"skip"}
    assert files(root) == before  # nothing changed, so there is no new version
    changed = {3: "# New\n\nother", 7: "", 9: "# Old\n\nbroken"}
    second = {r.doc_id: (r.action, r.chunks) for r in D.update(docs(changed), root, vectors, "m", 2).collect()}
    assert (second["d3"], second["d7"], second["d9"], second["d1"]) == (("index", 1), ("index", 0), ("failed", 1), ("skip", 0))
    new = files(root) - before
    assert before <= files(root)
    buckets = {r[0] for r in spark.createDataFrame([("d3",), ("d7",)], "doc_id string").select(D.bucket("doc_id", 16)).collect()}
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in new if "bucket=" in p} == buckets
    assert texts(D.read(spark, root)) == sorted([x for x in seen if x[0] not in ("d3", "d7")] + [("d3", 0, "# New\n\nother")])
    assert texts(D.read(spark, root, 1)) == seen
    assert [tuple(r) for r in D.lookup(spark, root, ["d3", "nowhere"]).select("doc_id", "content").collect()] == [("d3", "# New\n\nother")]
    with pytest.raises(Exception, match="2D"):
        D.update(docs(), root, vectors, "m", 3)
    gone = D.vacuum(spark, root, keep=1)
    assert "manifest/0000000001.json" in gone
    assert {int(p.split("bucket=")[1]) for p in gone if "bucket=" in p} == buckets
    assert D.read(spark, root).prints.count() == 41


def test_crash_before_manifest(spark, tmp_path, docs, monkeypatch):
    root = str(tmp_path / "index")
    D.update(docs(), root, vectors, "m", 2, buckets=4)
    old = texts(D.read(spark, root))
    publish = D.publish

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(D, "publish", dies)
    with pytest.raises(OSError, match="lost"):
        D.update(docs({1: "changed"}), root, vectors, "m", 2)
    assert texts(D.read(spark, root)) == old
    monkeypatch.setattr(D, "publish", publish)
    D.update(docs({1: "changed"}), root, vectors, "m", 2)
    assert ("d1", 0, "changed") in texts(D.read(spark, root))
    with pytest.raises(RuntimeError, match="another run"):
        D.publish(spark, root, D.manifest(spark, root))
