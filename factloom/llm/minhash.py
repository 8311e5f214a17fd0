"""Near-dedup by min-max hashing.

Under each permutation of the shingles both the smallest and the largest value are kept, so `bands` x `rows` signature
values cost half as many hash evaluations. Documents of one word sequence are one class. Classes that agree in all values
of a band share a bucket. Buckets are not expanded into pairs: first each member is compared with its bucket's pivot, on
full shingle sets; in large buckets that is the member most like the bucket's most frequent signature values, so that
copies of one text meet in it even if they are too far from each other. Buckets whose members are then still in several
components are cut into blocks of bounded rows and bytes, and tiles of two blocks compare the full sets of all their pairs
at once, by a product of matrices; a tile returns links that join what was apart, never all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, by_bytes, packed, tidy, unpacked
from factloom.llm.components import components

P = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    """Word to 64-bit hash; forgets all when it is large."""

    def __missing__(self, word):
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x):
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: Pairs whose smaller set has at most so many shingles meet and are compared exactly, whatever their signatures.
FEW = 16


def prefix_keys(shingle_hashes, percent: int):
    """Bucket keys of a set that may link with one of at most FEW shingles: its least shingles, so many that two sets that
    link share one of them; none for larger sets."""
    n = len(shingle_hashes)
    k = n - -(-percent * n // 100) + 1 if n * percent <= 100 * FEW else 0
    return mix64(shingle_hashes[:k] ^ P).view(np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only: A-Z, and space, tab, line feed, vertical tab, form feed, return."""
    return (text or b"").lower().split()


def shingles(words: list[bytes], k: int, hashes: Hashes):
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(1, len(h) - k + 1) if len(h) else 0
    s = np.full(n, min(k, len(h)), np.uint64)
    for j in range(min(k, len(h))):
        s = s * P + h[j : j + n]
    return np.unique(mix64(s))


def fingerprint(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class MinMax:
    """Band keys of a shingle set: (min, max) under bands * rows / 2 permutations of 32-bit values."""

    def __init__(self, bands: int, rows: int, seed: int):
        r = np.random.default_rng(seed)
        n = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.mul = (r.integers(0, 1 << 31, n, np.uint32) << np.uint32(1)) | np.uint32(1)
        self.add = r.integers(0, 1 << 32, n, np.uint32)
        self.salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * P)

    def sketch(self, signature) -> bytes:
        """A byte of each value, to compare signatures by."""
        return (signature & np.uint32(255)).astype(np.uint8).tobytes()

    def signature(self, shingle_hashes):
        x = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.mul), np.uint32)
        for i in range(0, len(x), 1024):
            v = x[i : i + 1024, None] * self.mul + self.add
            v ^= v >> np.uint32(15)
            np.minimum(low, v.min(0), out=low)
            np.maximum(high, v.max(0), out=high)
        return np.stack([low, high], 1).reshape(-1)

    def keys(self, signature):
        sig = signature.reshape(self.bands, self.rows).astype(np.uint64)
        key = self.salt.copy()
        for j in range(self.rows):
            key = mix64(key * P + sig[:, j])
        return key.view(np.int64)


def alike(s, t, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def overlaps(a: list, b: list, columns: int = 4096):
    """Sizes of the intersections of each of the sets a with each of the sets b (sorted hashes), as products of 0 and 1 over
    the hashes that both sides hold, some columns at a time; float32 sums are exact below 2^24 a chunk."""
    flat = [np.concatenate(x) for x in (a, b)]
    common, out = np.intersect1d(*flat), np.zeros((len(a), len(b)))
    sides = []
    for sets, f in zip((a, b), flat, strict=True):
        at = np.minimum(np.searchsorted(common, f), max(0, len(common) - 1))
        hit = common[at] == f if len(common) else np.zeros(len(f), bool)
        row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for k in range(0, len(common), columns):
        parts = []
        for (row, at), n in zip(sides, out.shape, strict=True):
            i, j = np.searchsorted(at, (k, k + columns))
            m = np.zeros((n, columns), np.float32)
            m[row[i:j], at[i:j] - k] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def tile(a, b, same: bool, percent: int):
    """(v, w) of links of two blocks of (v, n, c, sets) that join components; all pairs of them are compared in full."""
    up: dict = {}

    def root(c):
        while up.get(c, c) != c:
            up[c] = c = up.get(up[c], up[c])
        return c

    both = overlaps(a[3], b[3])
    link = (100 * both >= percent * (a[1][:, None] + b[1][None, :] - both)) & (a[2][:, None] != b[2][None, :])
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(link, 1) if same else link)), strict=True):
        c, d = root(int(a[2][i])), root(int(b[2][j]))
        if c != d:
            up[max(c, d)] = min(c, d)
            yield int(a[0][i]), int(b[0][j])


def middle(sketches):
    """The row most like the most frequent byte of each column, and in how many columns it has it."""
    most = np.array([np.bincount(col, minlength=256).argmax() for col in sketches.T], np.uint8)
    agree = (sketches == most).sum(1)
    return int(agree.argmax()), int(agree.max())


def half_turn(blocks: DataFrame, key: list[str]) -> DataFrame:
    """key, i, j: each two blocks of a key once, also each with itself; blocks has key, nb and block, 0 to nb - 1."""
    step = blocks.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("nb div 2")))).filter("not (nb % 2 = 0 and step = nb div 2 and block >= step)")
    return step.select(*key, F.col("block").alias("i"), F.pmod(F.col("block") + F.col("step"), F.col("nb")).alias("j"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None, k: int = 5, percent: int = 75, bands: int = 56, rows: int = 6, seed: int = 5, block_rows: int = 256, block_bytes: int = 2 << 20, pivot_from: int = 8, as_row: bool = False
) -> DataFrame:
    """One row per row of docs: id, payload, n_shingles, component_id (smallest id reachable by links), kept; with as_row the
    id and the payload as a struct `row`, else a payload of a result's name is left out.

    A-Z count as lower case; words are runs of other than ASCII white space. Sets: distinct k-word shingles, by 64-bit
    hash; of fewer words the whole sequence. Documents link when percent * union <= 100 * intersection. Null and blank
    texts have no shingles, link with nothing and stay. kept: id = component_id, so rows that repeat an id and a text
    stay together; null ids have the component of the smallest non-null id they reach, or null, and stay only in a
    component of null ids. Empty input gives no rows. docs must give the same rows each time it is read.
    Every pair that shares a bucket is compared on full sets, unless its documents are in one component already. Pairs
    whose smaller set has at most FEW shingles all share one. A larger pair of union u and intersection i shares no band
    with probability (1 - (i(i-1) / u(u-1))^(rows/2))^bands, as smallest and largest value agree together: 2.9e-5
    at most at the threshold as given. A block holds block_rows members and about block_bytes of sets at most, or one
    larger set; buckets of at least pivot_from members take their middle as pivot, others their first.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "minhash")
    text, own = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    #: Rows meet again by two hashes of their id and text: rows that agree in both may stand for each other.
    source = lambda *more: docs.select(*more, own.alias("id"), text.cast("binary").alias("t"), F.xxhash64(own, text).alias("h1"), F.xxhash64(text, F.lit(seed), own).alias("h2"))
    minmax = MinMax(bands, rows, seed)

    @F.arrow_udf("n long, fp binary, bands array<long>, sketch binary")
    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for part in (p for whole in texts for p in by_bytes(whole)):
            n, fp, keys, sketch = [], [], [], []
            for t in part.to_pylist():
                w = words_of(t)
                s = shingles(w, k, hashes)
                sig = minmax.signature(s) if w else None
                n.append(len(s))
                fp.append(fingerprint(w) if w else None)
                keys.append(np.concatenate([minmax.keys(sig), prefix_keys(s, percent)]) if w else None)
                sketch.append(minmax.sketch(sig) if w else None)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["n", "fp", "bands", "sketch"])

    signed = scratch.table(source().select("id", "h1", "h2", sign("t").alias("g")).select("id", "h1", "h2", "g.*"), "signed")
    classes = signed.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("first"), F.min(F.struct("h1", "h2")).alias("h"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.table(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("v", "n", F.explode("bands").alias("key"))
    shared = scratch.table(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    members = scratch.table(keyed.join(shared, "key"), "members")
    scratch.drop("shared")
    met = classes.join(members.select("v").distinct(), "v").select("v", "fp", "h.h1", "h.h2")

    @F.arrow_udf("binary")
    def sets(prints: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for fps, whole in prints:
            i = 0
            for part in by_bytes(whole):
                out = []
                for t in part.to_pylist():
                    w = words_of(t)
                    out.append(shingles(w, k, hashes).tobytes() if w and fingerprint(w) == fps[i].as_py() else None)  # hashes may agree by chance
                    i += 1
                yield pa.array(out, pa.binary())

    found = met.join(source().drop("id"), ["h1", "h2"]).select("v", sets("fp", "t").alias("s")).filter("s is not null")
    full = scratch.table(found.dropDuplicates(["v"]), "sets")
    tidy(spark)

    def confirm(batches):
        for b in batches:
            a, c = [], []
            for x, y, s, t in zip(*(b.column(i) for i in range(4)), strict=True):
                if alike(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), percent):
                    a.append(x.as_py())
                    c.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    def compare(batches):
        for b in batches:
            for r in range(b.num_rows):
                sides = []
                for col in (3, 4) if b.column(1)[r] != b.column(2)[r] else (3,):
                    m = b.column(col)[r].values
                    sides.append((*(m.field(f).to_numpy() for f in ("v", "n", "c")), [np.frombuffer(x.as_buffer(), np.uint64) for x in m.field("s")]))
                links = list(tile(sides[0], sides[-1], len(sides) == 1, percent))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def pivot(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                m = b.column(1)[r].values
                v, n = m.field("v").to_numpy(), m.field("n").to_numpy()
                order = np.argsort(v)
                i, agree = middle(np.frombuffer(b"".join(m.field("sketch").to_pylist()), np.uint8).reshape(len(m), -1)[order])
                out.append((b.column(0)[r].as_py(), agree, int(v[order][i]), int(n[order][i])))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], names=["key", "agree", "v", "n"])

    def in_blocks(now, *fields):
        """key, nb, block and m: the members of a block; now has key and nb of buckets."""
        return now.withColumn("block", F.pmod(F.xxhash64("v"), F.col("nb"))).groupBy("key", "nb", "block").agg(F.collect_list(F.struct(*fields)).alias("m"))

    first = members.groupBy("key").agg(F.min(F.struct("v", "n")).alias("p"))
    large = members.filter(F.col("size") >= pivot_from).withColumn("nb", F.ceil(F.col("size") / block_rows)).join(classes.select("v", "sketch"), "v")
    best = in_blocks(large, "v", "n", "sketch").select("key", "m").mapInArrow(pivot, "key long, agree long, v long, n long").groupBy("key").agg(F.max(F.struct("agree", (-F.col("v")).alias("u"), "v", "n")).alias("q"))
    pivots = scratch.table(first.join(best, "key", "left").select("key", F.coalesce("q.v", "p.v").alias("pv"), F.coalesce("q.n", "p.n").alias("pn")), "pivots")
    lo, hi = F.least("n", "pn"), F.greatest("n", "pn")
    pairs = members.join(pivots, "key").filter("v != pv").filter(lo * 100 >= hi * percent).select(F.least("pv", "v").alias("a"), F.greatest("pv", "v").alias("b")).distinct()
    both = pairs.join(full.select(F.col("v").alias("a"), "s"), "a").join(full.select(F.col("v").alias("b"), F.col("s").alias("t")), "b")
    links = scratch.table(both.select("a", "b", "s", "t").mapInArrow(confirm, "a long, b long"), "links0")
    scratch.drop("pivots")
    tidy(spark)
    label = components(links, scratch, "c0")
    # buckets whose members are in several components; of buckets of the same members one is enough
    now = scratch.table(members.select("key", "v", "n").join(label, "v", "left").withColumn("c", F.coalesce("c", "v")), "now")
    several = now.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("sum"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(seed))).alias("y")).filter("c0 != c1")
    several = several.groupBy("size", "sum", "x", "y").agg(F.min("key").alias("key"))
    several = scratch.table(several.select("key", F.greatest(F.ceil(F.col("size") / block_rows), F.ceil(8 * F.col("sum") / block_bytes)).alias("nb")), "several")
    open_ = now.join(several, "key").join(full, "v")
    blocks = scratch.table(in_blocks(open_, "v", "n", "c", "s"), "blocks")
    for done in ("now", "several", "members"):
        scratch.drop(done)
    tidy(spark)
    single = blocks.filter("nb = 1").select("key", F.col("block").alias("i"), F.col("block").alias("j"), F.col("m").alias("x"), F.expr("filter(m, e -> false)").alias("y"))
    tiles = half_turn(blocks.filter("nb > 1").select("key", "nb", "block"), ["key"])
    tiles = tiles.join(blocks.select("key", F.col("block").alias("i"), F.col("m").alias("x")), ["key", "i"]).join(blocks.select("key", F.col("block").alias("j"), F.col("m").alias("y")), ["key", "j"])
    tiles = single.unionByName(tiles.select("key", "i", "j", "x", "y"))
    more = scratch.table(tiles.mapInArrow(compare, "a long, b long"), "links1")
    label = components(links.unionByName(more), scratch, "c1")
    for done in ("blocks", "sets"):
        scratch.drop(done)
    tidy(spark)
    label = scratch.table(classes.select("v", "fp", "first").join(label, "v", "left").withColumn("c", F.coalesce("c", "v")), "label")
    top = scratch.table(label.groupBy("c").agg(F.min("first").alias("component_id")), "top")  # written, so that the join below can split a component of any size
    of = label.join(top, "c").select("fp", "component_id")
    spread = F.coalesce("fp", F.encode(F.hex("h1"), "UTF-8"))  # blank texts do not meet under one null
    known = signed.select("id", "h1", "h2", "n", "fp", spread.alias("key")).join(of.withColumnRenamed("fp", "key"), "key", "left")
    known = known.withColumn("component_id", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")))
    if set(payload or []) <= {id_col}:
        out = known.withColumn("row", F.struct(F.col("id").alias(id_col)))
    else:  # rows with all their columns are read again rather than kept beside the signatures
        known = scratch.table(known.select("h1", "h2", "n", "component_id").dropDuplicates(["h1", "h2"]), "known")
        out = source(packed(docs, id_col, payload)).drop("t").join(known, ["h1", "h2"])
    return unpacked(out, [F.col("n").alias("n_shingles"), "component_id", F.expr("id <=> component_id").alias("kept")], as_row)
