"""Tables written to the folder that all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset a local folder stands in if one process runs everything, as in tests;
    ValueError otherwise."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = "file://" + tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


class Work:
    """A folder of tables for one operator; it goes when the process ends, or by remove()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove, quiet=True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def remove(self, name: str = "", quiet: bool = False) -> None:
        with contextlib.suppress(Exception) if quiet else contextlib.nullcontext():  # at exit the JVM may be gone
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
