"""Ranked lexical search, score at a time over an index in impact order.

The index holds segments of documents, of bounded bytes of text. In a segment the postings of a term stand in groups of one
exact impact, largest first. A query takes the groups of its terms in falling order of what they add to a score, whichever
term they belong to, and adds it to the documents of each; it stops when what all terms can still add, taken together, lifts
no other document to the k-th best. Only then the scores of those that may be among the best are completed from the groups
left. Segments are searched side by side; the best of each are ranked together.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, by_bytes

#: ASCII letters and digits, A-Z in lower case, and all other code points; the rest of ASCII separates terms.
TERM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
RAW = "ids array<long>, sizes array<long>, terms array<string>, df array<long>, docs binary, tf binary"
INDEX = "ids array<long>, terms array<string>, ends array<long>, impacts binary, fill binary, docs binary"
#: Segments of a file: Spark writes and reads up to 100 and 4096 rows at once, whatever their size, but none beyond a file.
PER_FILE = {"maxRecordsPerFile": 1}


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM).split()


def segment(ids: pa.Array, texts: list[pa.Array]):
    """A row of RAW: terms in byte order, postings by term and document; df is the number of postings of each term."""
    number = defaultdict(count().__next__)  # numbers by len(number) would tie the dictionary to itself, and it would stay
    sizes, terms = [], []
    for part in texts:
        for t in part.to_pylist():
            own = terms_of(t)
            terms.append(np.fromiter((number[x] for x in own), np.int64, len(own)))
            sizes.append(len(own))
    names = sorted(number)
    place = np.empty(len(names), np.int64)
    place[[number[x] for x in names]] = np.arange(len(names))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pairs, tf = np.unique(place[np.concatenate(terms)] * len(sizes) + doc if len(doc) else doc, return_counts=True)
    df = np.bincount(pairs // len(sizes), minlength=len(names))
    return ids, sizes, [x.decode() for x in names], df, (pairs % len(sizes)).astype(np.uint32).tobytes(), tf.astype(np.uint32).tobytes()


def impacts(docs, tf, sizes, n: int, total: int):
    """(1000000000 * tf) div (1000 * tf + 8 * m), where m = 10 + (90 * size * n) div total."""
    m = np.array([10 + 90 * int(s) * n // total for s in sizes], np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])


def in_order(term, docs, impact):
    """Ends of each term's groups, the groups' impacts, the ends of their documents, and the documents."""
    order = np.lexsort((docs, -impact, term))
    term, docs, impact = term[order], docs[order], impact[order]
    first = np.flatnonzero(np.concatenate([[len(term) > 0], (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])]))
    return np.cumsum(np.bincount(term[first])), impact[first], np.append(first[1:], len(term)) if len(first) else first, docs


def best(groups: list[tuple], n_docs: int, k: int, docs, starts, ends, step: int = 256):
    """(document, score) of the k best, for groups as (contributions, numbers) of each term in falling order; ties go to the
    first documents. A score of 0 is none."""
    gains, number = (np.concatenate([g[i] for g in groups]) for i in (0, 1))
    term = np.repeat(np.arange(len(groups)), [len(g[0]) for g in groups])
    order = np.argsort(-gains, kind="stable")
    gains, number, term = gains[order], number[order], term[order]
    size = ends[number] - starts[number]
    upto = np.cumsum(size)
    tops, base = np.concatenate([g[0] for g in groups]), np.cumsum([0, *(len(g[0]) for g in groups)])
    score, done = np.zeros(n_docs, np.int64), 0

    def add(i, j, keep=None):
        take = np.repeat(starts[number[i:j]] - np.concatenate([[0], np.cumsum(size[i:j])[:-1]]), size[i:j]) + np.arange(size[i:j].sum())
        at, gain = docs[take], np.repeat(gains[i:j], size[i:j])
        if keep is not None:
            gain, at = gain[keep[at]], at[keep[at]]
        np.add.at(score, at, gain)

    while done < len(gains):
        to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + step, "right")))
        add(done, to)
        done, step = to, 2 * step
        if done == len(gains):
            break
        at = np.bincount(term[:done], minlength=len(groups)) + base[:-1]
        rest = int(tops[at[at < base[1:]]].sum())  # what every term's next group can still add
        if n_docs > k:
            limit = np.partition(score, n_docs - k)[n_docs - k]
            if limit > rest:  # no document that has nothing yet can reach the k-th
                keep = score + rest >= limit
                add(done, len(gains), keep)
                score[~keep] = 0
                break
    found = np.flatnonzero(score)
    if len(found) > k:
        limit = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= limit]  # ties at the k-th place are the caller's to rank
    return found, score[found]


def build(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 8 << 20):
    """The index of docs as a table of segments (INDEX), and each term's number of documents as (term, df).

    Every row is a document of its own, repeated ids too; null, empty and term-free texts are documents without terms and do
    not count. A segment holds segment_bytes of text, or one longer text.
    """
    spark = docs.sparkSession

    def cut(batches):
        ids, texts, size = [], [], 0

        def out():
            row = segment(pa.concat_arrays(ids), texts)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            lists = [pa.array([x], pa.list_(t)) for x, t in zip((row[0].to_pylist(), *row[1:4]), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in row[4:])], names=["ids", "sizes", "terms", "df", "docs", "tf"])

        for b in batches:
            done = 0
            for part in by_bytes(b.column(1), min(4 << 20, segment_bytes)):
                ids.append(b.column(0).slice(done, len(part)))
                texts.append(part)
                done, size = done + len(part), size + part.nbytes
                if size >= segment_bytes:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    raw = scratch.table(rows.mapInArrow(cut, RAW), "raw", **PER_FILE)
    df = raw.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    df = scratch.table(df, "df")
    n, total = raw.agg(F.sum(F.size(F.filter("sizes", lambda s: s > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s))).first()

    def weigh(batches):
        for b in batches:
            for r in range(b.num_rows):
                counts = b.column(3)[r].values.to_numpy()
                at, tf = (np.frombuffer(b.column(i)[r].as_buffer(), np.uint32) for i in (4, 5))
                ends, impact, fill, at = in_order(np.repeat(np.arange(len(counts)), counts), at, impacts(at, tf, b.column(1)[r].as_py(), n, total) if len(at) else at.astype(np.int64))
                lists = [b.column(0).slice(r, 1), b.column(2).slice(r, 1), pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in (impact.astype(np.uint32), fill.astype(np.uint32), at.astype(np.uint32)))], names=["ids", "terms", "ends", "impacts", "fill", "docs"])

    index = scratch.table(raw.mapInArrow(weigh, INDEX), "index", **PER_FILE)
    scratch.drop("raw")
    return index, df, n or 0


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", query_bytes: int = 4 << 20) -> DataFrame:
    """(query id, rank from 1, id, score): the k documents of largest score above 0 for each row of queries.

    Terms are runs of ASCII letters and digits and of all other code points, A-Z in lower case; each of a query's terms counts
    once. Equal scores rank by rising id, null last. Null texts have no terms; queries without results give no rows; rows of
    queries that repeat an id rank each for themselves, so that their ranks stand twice. Extra columns are ignored. Queries
    are broadcast to the segments in groups of query_bytes, or of one longer query; each group reads the index once.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked")
    index, df, n = build(docs, scratch, id_col, text_col)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({x.decode() for x in terms_of(t)}) for t in texts.to_pylist()], pa.list_(pa.string()))

    asked = queries.select(F.col(f"`{query_id}`").alias("item"), split(F.col(f"`{query_text}`").cast("string").cast("binary")).alias("terms")).withColumn("q", F.monotonically_increasing_id())
    asked = scratch.table(asked, "asked")
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.select("q", F.explode("terms").alias("term")).join(df, "term").select("q", "term", weight.alias("w")).filter("w > 0")
    ready = weighed.groupBy("q").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("w"), F.sum(F.octet_length("term") + 16).alias("bytes"))
    ready = scratch.table(ready, "ready")
    groups = max(1, -(-(ready.agg(F.sum("bytes")).first()[0] or 0) // query_bytes))
    ready = ready.withColumn("group", F.pmod(F.xxhash64("q"), F.lit(groups)))
    packed = scratch.table(ready.groupBy("group").agg(F.collect_list(F.struct("q", "terms", "w")).alias("queries")), "packed")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, terms, last = b.column(0)[r].values, b.column(1)[r].values, b.column(2)[r].values.to_numpy()
                impact, fill, at = (np.frombuffer(b.column(i)[r].as_buffer(), np.uint32).astype(np.int64) for i in (3, 4, 5))
                starts, out = np.concatenate([[0], fill[:-1]]), []
                all_ = b.column(6)[r].values
                where = pc.index_in(all_.field("terms").flatten(), value_set=terms).fill_null(-1).to_numpy()
                weights, cuts = all_.field("w").flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(all_.field("terms")).to_pylist()])
                for q, i, j in zip(all_.field("q").to_pylist(), cuts, cuts[1:], strict=False):
                    own = []
                    for t, w in zip(where[i:j].tolist(), weights[i:j].tolist(), strict=True):
                        if t >= 0:
                            a, z = int(last[t - 1]) if t else 0, int(last[t])
                            own.append((w * impact[a:z], np.arange(a, z)))
                    if own:
                        d, s = best(own, len(ids), k, at, starts, fill)
                        out += [(q, ids[x].as_py(), y) for x, y in zip(d.tolist(), s.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], names=["q", "id", "score"])

    found = None
    for g in range(groups):
        part = index.crossJoin(F.broadcast(packed.filter(F.col("group") == g).select("queries")))  # a group of bounded bytes, met by every segment
        part = part.mapInArrow(run, "q long, id long, score long")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    top = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(asked.select("q", "item").hint("merge"), "q").select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
