"""Embedding near-dedup by int8 tile products with error bounds.

A unit vector x is kept as int8 codes q with one scale s, and e = |x - s q| is computed, not estimated. Then
|x.y - s t q.r| <= e |t r| + f |x|, with t, r, f those of y, so a pair whose bounds lie on one side of the threshold is
decided; of the rest the cosine is computed in double precision. Only vectors of one label meet, in tiles of two blocks of
bounded size. Blocks are quantised once, and tiles get codes only; the full vectors go to tiles with pairs left to decide.
A tile returns each vector's number of links and a spanning forest of its links, never all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import Scratch
from factloom.llm.components import components
from factloom.llm.minhash import half_turn


def scaled(x):
    """Rows times a power of two each, which is exact, so that no square of a component overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x):
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(x):
    """Codes, scales, errors and lengths of the quantised vectors, of unit vectors."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - q * scale[:, None], axis=1)
    return q, scale, error * (1 + 1e-9) + 1e-12, scale * np.linalg.norm(q.astype(np.float64), axis=1) * (1 + 1e-9)


def tile_links(a, b, least: float, same: bool):
    """Pairs (i, j) of rows of a and b, both as quantise() gives them: those whose cosine is surely at least `least`, and
    those of which the codes do not tell; i < j if both are the same block."""
    qa, sa, ea, _ = a
    qb, sb, eb, length = b
    sure, open_ = [], []
    exact = np.float32 if qb.shape[1] <= 1024 else np.float64  # sums of products of codes stay below 2^24
    fb = qb.astype(exact).T
    for i in range(0, len(qa), 512):
        about = (qa[i : i + 512].astype(exact) @ fb) * (sa[i : i + 512, None] * sb[None, :])
        error = ea[i : i + 512, None] * length[None, :] + eb[None, :] + 1e-6
        yes = about - error >= least
        for found, hit in ((sure, yes), (open_, (about + error >= least) & ~yes)):
            r, c = np.nonzero(hit)
            r += i
            found.append(np.stack([r, c])[:, r < c] if same else np.stack([r, c]))
    return np.concatenate(sure, 1), np.concatenate(open_, 1)


def cosine(x, y):
    """Of rows that scaled() made."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def forest(i, j, n: int):
    """Those of the links that join parts which earlier ones had not joined."""
    up, keep = list(range(n)), []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(k)
    return keep


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = 1024, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of vectors: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Vectors link when their labels are equal and not null, their lengths agree and their cosine is at least threshold.
    Vectors that are null, empty or zero, or hold null or non-finite components, and rows of null label link with
    nothing. Equal vectors of a label are compared as one and counted as many. kept: id = component_id, null ids last
    and kept only where no other id is reached. Empty input gives no rows; other columns are ignored. A block has about
    `block` vectors, or as many as have block_bytes of codes if these are fewer.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    vec = F.col("x")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("x", F.when(F.coalesce(good, F.lit(False)), vec))
    apart = rows.filter("x is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    distinct = rows.filter("x is not null").groupBy("label", "x").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    distinct = scratch.table(distinct.withColumn("v", F.monotonically_increasing_id()), "distinct")
    key = ["label", "dim"]
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(block_bytes) / F.col("dim"))))
    blocks = distinct.groupBy("label", F.size("x").alias("dim")).agg(F.count("*").alias("n")).select(*key, F.ceil(F.col("n") / size).alias("nb"))
    kind = dict(rows.dtypes)["label"]
    codes = ["ids", "copies", "q", "scale", "error", "length"]
    schema = pa.schema([("label", to_arrow_type(rows.schema["label"].dataType)), ("dim", pa.int32()), ("nb", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in [*codes, "x"])])

    def pack(table: pa.Table) -> pa.Table:
        t = table.take(pa.array(np.argsort(table["v"].to_numpy()))).combine_chunks()
        x = t["x"].chunk(0).flatten().to_numpy().reshape(t.num_rows, -1)
        cols = [t["v"].to_numpy(), t["copies"].to_numpy(), *quantise(unit(x)), scaled(x)]
        one = {c: [t[c][0].as_py()] for c in ("label", "dim", "nb", "block")}
        return pa.table(one | {c: [np.ascontiguousarray(a).tobytes()] for c, a in zip([*codes, "x"], cols, strict=True)}, schema=schema)

    assigned = distinct.select("label", F.size("x").alias("dim"), "v", "copies", "x").join(blocks, key).withColumn("block", F.pmod(F.xxhash64("v"), F.col("nb")))
    packed = scratch.table(assigned.groupBy(*key, "nb", "block").applyInArrow(pack, f"label {kind}, dim int, nb long, block long, " + ", ".join(f"{c} binary" for c in [*codes, "x"])), "blocks")
    tiles = half_turn(packed.select(*key, "nb", "block"), key)
    tiles = tiles.repartition(*(F.col(c) for c in (*key, "i", "j")))

    def sides(of, cols):
        side = lambda s: packed.select(*key, F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in cols))
        return of.join(side("i"), [*key, "i"]).join(side("j"), [*key, "j"])

    def read(b, r, at, dim):
        ids, copies, q, scale, error, length = (np.frombuffer(b.column(at + k)[r].as_buffer(), t) for k, t in enumerate((np.int64, np.int64, np.int8, np.float64, np.float64, np.float64)))
        return ids, copies, (q.reshape(-1, dim), scale, error, length)

    out_schema = pa.schema([schema.field(0), schema.field(1), ("i", pa.int64()), ("j", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("open", pa.binary())])

    def links(p, q, same, u, m, w, n):
        """Counts of the links (p, q) of two blocks of ids u and w, that stand for m and n rows, and a forest of them."""
        ids = u if same else np.concatenate([u, w])
        q_ = q if same else q + len(u)
        count = np.bincount(p, n[q], len(ids)) + np.bincount(q_, m[p], len(ids))
        k, at = np.array(forest(p, q_, len(ids)), np.int64), np.nonzero(count)[0]
        return np.concatenate([ids[at], u[p[k]]]), np.concatenate([np.zeros(len(at), np.int64), w[q[k]]]), np.concatenate([count[at], np.zeros(len(k))]).astype(np.int64), len(at)

    def batch(a, b, n, counts):
        """Rows (a, null, n) of counts, then links (a, b, 0)."""
        empty = [pa.nulls(len(a), f.type) for f in out_schema]
        return pa.RecordBatch.from_arrays([*empty[:4], pa.array(a), pa.array(b, mask=np.arange(len(a)) < counts), pa.array(n), empty[7]], schema=out_schema)

    def compare(batches):
        for t in batches:
            for r in range(t.num_rows):
                label, dim, i, j = (t.column(c)[r].as_py() for c in range(4))
                (u, m, a), (w, n, b) = read(t, r, 4, dim), read(t, r, 10, dim)
                (p, q), open_ = tile_links(a, b, threshold, i == j)
                if len(p):
                    yield batch(*links(p, q, i == j, u, m, w, n))
                if open_.shape[1]:
                    one = [label, dim, i, j, None, None, None, open_.astype(np.int32).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one, out_schema, strict=True)], schema=out_schema)

    def recompute(batches):
        for t in batches:
            for r in range(t.num_rows):
                dim, i, j = (t.column(c)[r].as_py() for c in range(3))
                u, m, x, w, n, y = (np.frombuffer(t.column(4 + k)[r].as_buffer(), d) for k, d in enumerate((np.int64, np.int64, np.float64) * 2))
                x, y = x.reshape(-1, dim), y.reshape(-1, dim)
                p, q = np.frombuffer(t.column(3)[r].as_buffer(), np.int32).astype(np.int64).reshape(2, -1)
                hit = np.concatenate([cosine(x[p[k : k + 65536]], y[q[k : k + 65536]]) >= threshold for k in range(0, len(p), 65536)])
                if hit.any():
                    yield batch(*links(p[hit], q[hit], i == j, u, m, w, n))

    out_type = f"label {kind}, dim int, i long, j long, a long, b long, n long, open binary"
    first = scratch.table(sides(tiles, codes).select(*key, "i", "j", *(f"{c}_i" for c in codes), *(f"{c}_j" for c in codes)).mapInArrow(compare, out_type), "first")
    full = ["ids", "copies", "x"]
    second = sides(first.filter("open is not null").select(*key, "i", "j", "open"), full).select("dim", "i", "j", "open", *(f"{c}_i" for c in full), *(f"{c}_j" for c in full))
    second = scratch.table(second.mapInArrow(recompute, out_type).select("a", "b", "n"), "second")
    found = first.filter("open is null").select("a", "b", "n").unionByName(second)
    direct = found.filter("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("links"))
    label = components(found.filter("b is not null").select("a", "b"), scratch, "c")
    scratch.drop("blocks")
    known = distinct.select("v", "copies", "first").join(direct, "v", "left").join(label, "v", "left").withColumn("c", F.coalesce("c", "v"))
    known = scratch.table(known, "labels")
    top = scratch.table(known.groupBy("c").agg(F.min("first").alias("component_id")), "top")  # written, so that the join below can split a component of any size
    known = known.join(top, "c").select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    known = scratch.table(distinct.select("v", "label", "x").join(known, "v").drop("v"), "known")  # written, so that the join below can split copies of any number
    linked = rows.filter("x is not null").join(known, ["label", "x"]).select("id", "n_links", "component_id")
    return apart.unionByName(linked).select(F.col("id").alias(id_col), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"))
