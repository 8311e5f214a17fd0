"""Substring dedup by fixed-block anchors.

A repeat of `window` words holds a whole block of half its length, wherever it begins: every document's words are cut into
non-overlapping blocks of (window + 1) // 2 words, whose hashes are the index, and every rolling window of a block's length
probes it. Only what hits goes on: each hit is extended to the windows around it, by as many words on either side as the
block leaves, where the document that holds the block has the same words; windows that follow each other make up the maximal
exact repeats.

Documents are worked on in batches of bounded bytes. A hash leaves a batch once, however often it occurs there, and meets the
batches that share it in a part of hash space of bounded size: a passage that a third of all documents hold is a row of each
batch, never of each document or pair. What a part finds goes back to the batches that asked.
"""

from __future__ import annotations

import functools
import itertools
import math
import time

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, by_bytes, tidy
from factloom.llm.minhash import P, mix64

LAST = np.iinfo(np.int64).max
MESSAGE = "part int, batch long, keys binary, flags binary, ids binary"
ANSWER = "batch long, keys binary, ids binary"


#: Odd numbers that stand for bytes, and the base of the sum that makes a word's hash of them.
BYTES = np.random.default_rng(12).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 20


@functools.cache
def powers(size: int):
    """The first powers of BASE, and of the number by which it is undone; sizes are powers of two."""
    undo = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)]), dtype=np.uint64) for x in (BASE, undo))


def word_hashes(text: bytes):
    """A hash of each word of a text with single spaces, some bytes at a time."""
    data, out, at = np.frombuffer(text, np.uint8), [np.zeros(0, np.uint64)], 0
    while at < len(text):
        cut = len(text) if at + CHUNK >= len(text) else text.rfind(b" ", at, at + CHUNK)
        cut = cut if cut > at else text.find(b" ", at + CHUNK)
        piece = data[at : cut if cut > at else len(text)]
        gaps = np.flatnonzero(piece == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(piece))
        up, down = powers(1 << max(20, int(len(piece)).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[piece] * up[: len(piece)], dtype=np.uint64)])
        out.append(mix64((sums[ends] - sums[starts]) * down[starts]))
        at += len(piece) + 1
    return np.concatenate(out)


class Words:
    """Word hashes of texts side by side, of n words each; `at` is each word's place in its text, `left` the words from it to
    the end."""

    def __init__(self, texts: list[bytes], n, ids):
        self.h, self.n, self.ends = word_hashes(b" ".join(t for t in texts if t)), n, np.cumsum(n)
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.at = np.arange(len(self.h)) - np.repeat(self.ends - n, n)
        self.left = np.repeat(n, n) - self.at
        self.id = ids[self.doc]

    def rolling(self, k: int):
        """A hash of the k words from each place on, and whether there are so many."""
        n = len(self.h) - k + 1
        r = np.full(len(self.h), k, np.uint64)
        if n > 0:
            for j in range(k):
                r[:n] = r[:n] * P + self.h[j : j + n]
        return mix64(r), self.left >= k

    def near(self, hit, length: int):
        """Whether any of `length` places from each one on is hit."""
        sums = np.concatenate([[0], np.cumsum(hit), np.full(length, hit.sum())])
        return sums[length : length + len(hit)] > sums[: len(hit)]


def pack(keys, width: int) -> bytes:
    """Sorted keys by their `width` most significant bytes: differences, all first bytes before all second ones, so that the
    bytes that are zero in most differences stand together and compress."""
    steps = np.diff(keys >> np.uint64(64 - 8 * width), prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes, width: int):
    steps = np.zeros((len(raw) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64) << np.uint64(64 - 8 * width)


def cut_off(keys, width: int):
    """The keys as they are after pack and unpack."""
    return keys & ~np.uint64((1 << (64 - 8 * width)) - 1)


def firsts(keys):
    """Where each distinct key begins, in sorted keys."""
    return np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))


def bounds(keys, parts: int):
    """Where the keys of each part begin, in sorted keys; parts are equal ranges."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def least(keys, ids):
    """Distinct keys in order, with the smallest id of each."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    at = firsts(keys)
    return keys[at], np.minimum.reduceat(ids, at) if len(at) else ids


def messages(batch: int, probes, docs, refs, ids, parts: int, width: int):
    """Rows of MESSAGE: the distinct keys of a batch; bits of whether each is a probe, one of several texts, and a reference;
    the smallest id of each reference."""
    probes = cut_off(probes, width)
    order = np.argsort(probes)
    probes, docs = probes[order], docs[order]
    at = firsts(probes)
    many = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at) if len(at) else np.zeros(0, bool)
    refs, ids = least(cut_off(refs, width), ids)
    keys = np.union1d(probes[at], refs)
    flags = np.zeros((3, len(keys)), bool)
    place = np.searchsorted(keys, probes[at])
    flags[0, place], flags[1, place], flags[2, np.searchsorted(keys, refs)] = True, many, True
    begin, edges = np.concatenate([[0], np.cumsum(flags[2])]), bounds(keys, parts)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            yield i, batch, pack(keys[a:b], width), np.packbits(flags[:, a:b]).tobytes(), ids[begin[a] : begin[b]].tobytes()


def meeting(width: int, texts: int):
    """Of a part: which probes of each batch some reference has, if at least so many texts probe with them, with its smallest id."""

    def meet(table: pa.Table) -> pa.Table:
        asked, known, out = [], [np.zeros(0, np.uint64)], []
        for batch, raw, bits in zip(*(table.column(c).to_pylist() for c in ("batch", "keys", "flags")), strict=True):
            keys = unpack(raw, width)
            probe, many, ref = np.unpackbits(np.frombuffer(bits, np.uint8), count=3 * len(keys)).reshape(3, -1).astype(bool)
            known.append(keys[ref])
            asked.append((batch, keys[probe], many[probe]))
        refs, ids = least(np.concatenate(known), np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64))
        times, found = np.zeros(len(refs), np.int64), []
        for batch, keys, many in asked if len(refs) else []:
            i = np.minimum(np.searchsorted(refs, keys), len(refs) - 1)
            same = refs[i] == keys
            times[i[same]] += 1 + many[same]
            found.append((batch, i[same]))
        for batch, i in found:
            i = i[times[i] >= texts]
            if len(i):
                out.append((batch, pack(refs[i], width), ids[i].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["batch", "keys", "ids"])

    return meet


def answers(table: pa.Table, width: int):
    """Sorted keys and their smallest ids."""
    keys = [np.zeros(0, np.uint64), *(unpack(raw, width) for raw in table.column("keys").to_pylist())]
    return least(np.concatenate(keys), np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64))


def lookup(keys, known, ids):
    """The id of each key, LAST where it is not known."""
    if not len(known):
        return np.full(len(keys), LAST)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[i] == keys, ids[i], LAST)


def settle(spark) -> None:
    """Lets shuffle files of the step before go: what a first collection frees may hold others."""
    for _ in range(2):
        tidy(spark)
        time.sleep(0.5)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, batch_bytes: int = 8 << 20, part_bytes: int = 12 << 20) -> DataFrame:
    """One row per row of docs: id, n_words, spans (array of start and end of removed words), kept (the other words, joined by
    one space).

    Words are runs of other than ASCII white space, unchanged. A word goes if it is in a run of `window` words of one text that
    also begins in a text with a smaller id; runs are judged on the input. Rows that share an id remove nothing from each
    other; a null id counts as the largest. Null, blank and short texts have no windows and stay; null gives no words and an
    empty text. Ids are longs; other columns of docs are ignored, whatever their names. Empty input gives no rows. The
    last comparison is by a 64-bit hash of all words of a window, among windows with an anchor.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    spark, scratch, block = docs.sparkSession, Scratch(docs.sparkSession, "repeats"), (window + 1) // 2

    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
    names = ["part", "batch", "keys", "flags", "ids"]

    def cut(batches):
        part, turn = TaskContext.get().partitionId(), 0
        for b in batches:
            done = 0
            for texts in by_bytes(b.column(1), batch_bytes):
                words = [(t or b"").split() for t in texts.to_pylist()]
                rows = [pa.array([(part << 32) + turn] * len(words), pa.int64()), b.column(0).slice(done, len(words)), pa.array([len(w) for w in words], pa.int64()), pa.array([b" ".join(w) for w in words], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["batch", "id", "n", "text"])
                done, turn = done + len(words), turn + 1

    def numbers(table, begin: int, end: int) -> Words:
        part = table.slice(begin, end - begin)
        return Words(part.column("text").to_pylist(), part.column("n").to_numpy(), part.column("id").fill_null(LAST).to_numpy())

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    rows = scratch.table(rows.mapInArrow(cut, "batch long, id long, n long, text binary"), "rows")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-8 * total // part_bytes))
    width = min(8, math.ceil((math.log2(total + 1) + 12) / 8))  # of so long a hash, one in 4096 windows hits by chance

    def anchors(batches):
        for b in batches:
            batch = b.column("batch").to_numpy()
            edges = [*firsts(batch).tolist(), len(batch)]
            for i, j in zip(edges, edges[1:], strict=False):
                w = numbers(b, i, j)
                h, whole = w.rolling(block)
                index = whole & (w.at % block == 0)
                for m in messages(int(batch[i]), h[whole], w.doc[whole], h[index], w.id[index], parts, width):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(m, kinds, strict=True)], names=names)

    hits = scratch.table(rows.mapInArrow(anchors, MESSAGE).groupBy("part").applyInArrow(meeting(width, 2), ANSWER), "hits")
    settle(spark)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            w = numbers(left, 0, left.num_rows)
            h, whole = w.rolling(block)
            first = np.where(whole, lookup(cut_off(h, width), *answers(right, width)), LAST)
            keys, full = w.rolling(window)
            probe, index = (full & w.near(hit, window - block + 1) for hit in (first < w.id, (first < LAST) & (w.at % block == 0)))
            out = list(messages(left.column("batch")[0].as_py(), keys[probe], w.doc[probe], keys[index], w.id[index], parts, 8))
        return pa.table([pa.array([m[i] for m in out], t) for i, t in enumerate(kinds)], names=names)

    found = rows.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extend, MESSAGE).groupBy("part").applyInArrow(meeting(8, 1), ANSWER)
    found = scratch.table(found, "found")
    scratch.drop("hits")
    settle(spark)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, spans = left.column("text").to_pylist(), [[] for _ in range(left.num_rows)]
        if right.num_rows:
            w = numbers(left, 0, left.num_rows)
            keys, full = w.rolling(window)
            go = full & (lookup(keys, *answers(right, 8)) < w.id)
            steps = np.zeros(len(go) + window, np.int64)
            steps[: len(go)] += go
            steps[window:] -= go
            gone = np.cumsum(steps)[: len(go)] > 0
            for i in np.unique(w.doc[gone]).tolist():
                stay = ~gone[w.ends[i] - w.n[i] : w.ends[i]]
                turn = np.flatnonzero(np.diff(np.concatenate([[1], stay, [1]]))).tolist()
                spans[i] = [{"start": s, "end": e} for s, e in zip(turn[::2], turn[1::2], strict=True)]
                texts[i] = b" ".join(itertools.compress(texts[i].split(), stay.tolist()))
        return pa.table([left.column("id"), left.column("n"), pa.array(spans, span), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n", "spans", "kept"])

    out = rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(remove, "id long, n long, spans array<struct<start: long, end: long>>, kept string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "spans", "kept")
