"""Shared folder, written tables and running sums over sorted tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of other characters are words; these are space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a local one only where none is set and Spark runs in one
    process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch folders in order of their making.
LIVE: list[Scratch] = []


def sweep(since: int = 0) -> None:
    """Drops the scratch folders made since LIVE was so long."""
    while len(LIVE) > since:
        LIVE.pop().drop()


atexit.register(sweep)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors. They go by drop(), by sweep(), or when the
    process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_root(spark)}/factloom-{name}-{uuid.uuid4().hex}"
        LIVE.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # at exit the JVM may be gone already; the folder is the cluster's to clean then
            if name:
                raise


#: Bytes of a batch that goes to a Python worker.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python worker at once, for this session: its default of 64 MB is held several times over,
    by each task on both sides. A smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, BATCH)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that are done: it does so once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def by_bytes(values: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """The values of a string or binary array in slices of about `most` bytes, or of one longer value."""
    at = np.frombuffer(values.buffers()[1], np.int64 if values.type in (pa.large_string(), pa.large_binary()) else np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else []
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield values.slice(begin, end - begin)
        begin = end


def packed(docs: DataFrame, id_col: str, payload: list[str] | None):
    """The id and the payload's columns as one struct, beside which results may have any name."""
    return F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys([id_col, *(payload or [])]))).alias("row")


def unpacked(out: DataFrame, results: list, as_row: bool) -> DataFrame:
    """`row` and the results, or its columns instead of it; of columns of one name the result stays."""
    if as_row:
        return out.select("row", *results)
    own = out.select(*results).columns
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in out.schema["row"].dataType.names if c not in own), *results)


def held_out(id_col: str, parts: int):
    """True where crc32 of the id as text leaves remainder 0; a null id counts as empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 0


def running(df: DataFrame, order: list[str], sums: dict[str, str], scratch: Scratch, name: str) -> tuple[DataFrame, list]:
    """A written copy of df in global order, with `part` and, for each (new column, source column) of sums, the running
    sum within the part, its own row included. Second: (part, total of each sum) in order, one row for each part."""
    cols = df.columns
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "part int", *(f"`{k}` long" for k in sums)])

    def add(batches):
        part, last = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for b in batches:
            extra = [pa.array(np.full(b.num_rows, part, np.int32))]
            for k, src in sums.items():
                cum = np.cumsum(b.column(cols.index(src)).to_numpy(zero_copy_only=False).astype(np.int64)) + last[k]
                last[k] = int(cum[-1]) if len(cum) else last[k]
                extra.append(pa.array(cum))
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*cols, "part", *sums])

    written = scratch.table(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), name)
    totals = written.groupBy("part").agg(*(F.max(k).alias(k) for k in sums)).orderBy("part").collect()
    return written, totals
