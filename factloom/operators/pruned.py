"""V1: exact nearest neighbours that skip what cannot be near.

Every vector belongs to the cell of its nearest pivot. By the triangle inequality no vector of a cell is nearer to a query than
its distance to the pivot less the cell's radius, nor than the cell's smallest distance less that. A query first searches the
nearest cells that hold k vectors, which bounds its k-th distance, and then only cells that may hold nearer ones. Results are
those of the full search; only how many cells are skipped depends on the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.retrieval import nearest
from factloom.operators.written import Work

#: Pivots at most, a sample by hash; rows of vectors and of queries that meet in one comparison.
PIVOTS, BLOCK, QUERIES = 128, 1024, 256
#: What rounding may add to a distance.
SLACK = 1e-9


def _valid(df: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(id_col).alias("id"), x.alias("x")).filter(F.coalesce(whole, F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(pivots)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - pivots[None, :, j]) ** 2
    return np.sqrt(out)


def knn_pruned(chunks: DataFrame, queries: DataFrame, k: int, dims: int, key: str, id_col: str, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(key, id, distance, rank) of the k nearest of chunks(id, embedding) for each of queries(key, vector), equal distances by id;
    and one row with how many pairs of a query and a vector there are, and how many were compared.

    Vectors of other length, null ones and those that hold nulls, NaN or infinities are not found and find nothing. Keys and ids
    differ from row to row. Pivots and the extents of their cells are the only things that the driver holds.
    """
    if not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    work = Work(chunks.sparkSession, "pruned")
    v, q = _valid(chunks, id_col, "embedding", dims), _valid(queries, key, "vector", dims)
    kinds = dict(v.dtypes)["id"], dict(q.dtypes)["id"]
    sample = v.orderBy(F.xxhash64("id", "x"), "id").limit(pivots).select("x").collect()  # PIVOTS rows
    centres = np.array([r["x"] for r in sample], np.float64).reshape(-1, dims)

    def assign(batches):
        for b in batches:
            d = _to_pivots(_matrix(b.column(1), dims), centres)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=["id", "x", "cell", "r"])

    cells = work.table(v.mapInArrow(assign, f"id {kinds[0]}, x array<double>, cell int, r double"), "cells")
    extent = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()  # a row for each pivot
    at = np.array([e["cell"] for e in extent], np.int64)
    n, lo, hi = (np.array([e[c] for e in extent], np.float64) for c in ("n", "lo", "hi"))

    def plan(batches):
        for b in batches:
            d = _to_pivots(_matrix(b.column(1), dims), centres[at]) if len(at) else np.zeros((b.num_rows, 0))
            near = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(n[near], axis=1) - n[near]  # vectors in nearer cells
            rows = np.repeat(np.arange(b.num_rows), len(at))
            cell = near.reshape(-1)
            least = np.maximum(0, np.maximum(d[rows, cell] - hi[cell], lo[cell] - d[rows, cell]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(at[cell], pa.int32()), pa.array(least), pa.array(before.reshape(-1) < k)], names=["id", "x", "cell", "least", "first"])

    pairs = work.table(q.mapInArrow(plan, f"id {kinds[1]}, x array<double>, cell int, least double, first boolean"), "pairs")
    sizes = chunks.sparkSession.createDataFrame([(int(e["cell"]), int(e["n"])) for e in extent], "cell int, n long")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    blocks = cells.join(F.broadcast(sizes), "cell").groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("id", "x")).alias("v"))  # a row for each pivot
    blocks = work.table(blocks, "blocks")

    def compare(batches):
        for b in batches:
            for r in range(b.num_rows):
                ours, theirs = b.column(0)[r].values, b.column(1)[r].values
                order = np.argsort(ours.field("id").to_numpy(zero_copy_only=False), kind="stable")
                x, y = _matrix(ours.field("x"), dims)[order], _matrix(theirs.field("x"), dims)
                for i, j, d in nearest(x, y, np.zeros(len(x), bool), k):
                    yield pa.RecordBatch.from_arrays([theirs.field("id").take(pa.array(i)), ours.field("id").take(pa.array(order[j])), pa.array(d)], names=["key", "id", "distance"])

    def searched(some: DataFrame, name: str) -> DataFrame:
        groups = some.groupBy("cell", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(-(-total // QUERIES)))).alias("group")).agg(F.collect_list(F.struct("id", "x")).alias("q"))
        met = blocks.join(groups.hint("merge"), "cell").select("v", "q").mapInArrow(compare, f"key {kinds[1]}, id {kinds[0]}, distance double")
        return work.table(met, name)

    total = q.count()
    place = F.row_number().over(Window.partitionBy("key").orderBy("distance", "id"))
    first = searched(pairs.filter("first"), "first")
    bound = first.withColumn("rank", place).filter(F.col("rank") == k).select(F.col("key").alias("id"), F.col("distance").alias("bound"))
    others = pairs.filter("not first").join(bound.hint("merge"), "id", "left").filter(F.col("least") <= F.coalesce(F.col("bound"), F.lit(float("inf"))) * (1 + SLACK) + SLACK)
    others = work.table(others.select("id", "x", "cell"), "others")
    both = first.unionByName(searched(others, "second")).withColumn("rank", place).filter(F.col("rank") <= k)
    looked = pairs.filter("first").select("cell").unionByName(others.select("cell")).join(F.broadcast(sizes), "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    stats = looked.select((F.lit(total) * F.lit(int(n.sum()))).cast("long").alias("pairs"), "compared")
    return both.select(F.col("key").alias(key), F.col("id").alias(id_col), "distance", "rank"), stats
