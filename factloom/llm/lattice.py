"""LM scoring by subword lattice likelihood.

A text is the sequence of its words, each a mark and its bytes, then one end. A unigram model over the pieces of an
existing vocabulary generates a word piece by piece; the probability of a word, seen in training or not, is the sum over
all its segmentations, by forward recursion in log space. The weight of a segmentation is exp(sharpness * sum of the
vocabulary's scores, as logarithms), normalised over all pieces. The training documents give two numbers, by expectation
maximisation over all their words: the sharpness (1 takes the scores as they are) and the probability of the end. All of
this is done once for each distinct word, not for each occurrence.

With `learn` the words of training are edges as well: such an edge has the word's share of the training words less a
discount (Ney's, n1 / (n1 + 2 n2)), and what the discounts leave goes to the segmentations into pieces, whose weights are
learned from the distinct training words, pieces that begin a word and others apart, with the probability that a word ends.
Probabilities of all texts still sum to one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, by_bytes, held_out
from factloom.llm.minhash import mix64
from factloom.llm.pieces import Numbers
from factloom.llm.vocabulary import MODEL, load

K = np.uint64(0x9E3779B97F4A7C15)


#: Words of more bytes go through the recursion alone, piece by piece.
LONG = 256


#: Uses that a piece has beside those that learning finds, so that none is impossible.
RARE = 0.01


#: Files give pieces that no merge makes, such as the mark alone, scores below this.
NEVER = -1e8


def pieces(path: str = MODEL, zipf: bool = True) -> tuple[list[bytes], np.ndarray]:
    """Distinct surfaces, the 256 single bytes first, and their scores as logarithms. Scores of a unigram file are logarithms
    already; those of a file of merges are ranks (0, -1, -2, ...), and by Zipf's law the logarithm of a rank's share is
    -log(1 + rank), up to the sharpness (without zipf they stay as they are). A byte that is no piece has the score of a character that no piece has: the file's
    least one less 10; so has a piece that the file never makes. Words carry one mark and
    no white space, so pieces with more of it are no edges."""
    v = load(path)
    own = [(v.surface[i], v.scores[i]) for i in v.ids.values() if len(v.surface[i].removeprefix(b" ").split()) < 2 and v.surface[i].removeprefix(b" ").strip() == v.surface[i].removeprefix(b" ")]
    least = min(s for _, s in own if s > NEVER) - 10
    score = {bytes([b]): least for b in range(256)}
    for s, x in own:
        score[s] = max(score.get(s, least), x)
    scores = np.array(list(score.values()))
    ranks = zipf and (scores <= 0).all() and (scores == np.rint(scores)).all()
    return list(score), -np.log1p(-scores) if ranks else scores


def log_weights(scores, sharpness: float):
    """Normalised log weights of the pieces."""
    x = sharpness * scores
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def sharpness_of(scores, mean: float) -> float:
    """The sharpness under which a piece's expected score is `mean`: the likelihood of pieces of that mean has its maximum there."""
    low, high = 0.0, 1.0
    if mean <= scores.mean():
        return 0.0
    while high < 64 and (np.exp(log_weights(scores, high)) * scores).sum() < mean:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        if (np.exp(log_weights(scores, mid)) * scores).sum() < mean:
            low = mid
        else:
            high = mid
    return (low + high) / 2


class Lattice:
    """Finds all pieces in words, by a 64-bit hash of their bytes in a table sorted by hash and entered by its top bits."""

    def __init__(self, surfaces: list[bytes]):
        self.longest = max(map(len, surfaces))
        keys = np.zeros(len(surfaces), np.uint64)
        for i, s in enumerate(surfaces):
            h = 0
            for b in s:
                h = (h * int(K) + b + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = h
        keys = mix64(keys)
        order = np.argsort(keys)
        self.keys = keys[order]
        slot = (self.keys >> np.uint64(44)).astype(np.int64)  # 2^20 runs of keys, each of a few
        self.first = np.searchsorted(slot, np.arange((1 << 20) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max())
        self.order = np.append(order, -1).astype(np.int32)
        self.keys = np.append(self.keys, np.uint64(0))

    def find(self, h):
        """Piece of each hash, -1 if none."""
        h = mix64(h)
        at = self.first[(h >> np.uint64(44)).astype(np.int32)]
        out = np.full(h.shape, -1, np.int32)
        for _ in range(self.deepest):
            np.copyto(out, self.order[at], where=self.keys[at] == h)
            at = np.minimum(at + 1, len(self.keys) - 1)
        return out

    def edges(self, x):
        """For words of equal length (rows of bytes): list over piece lengths l of the pieces at [i, i + l)."""
        n, h, out = x.shape[1], np.zeros(x.shape, np.uint64), []
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, : n - size + 1] * K + x[:, size - 1 :].astype(np.uint64) + np.uint64(1)
            out.append(self.find(h))
        return out


def forward(edges, logp, n: int, scores=None):
    """For words of n bytes each: the log of the summed weight of all segmentations; with scores also the expected number of
    pieces and the expected sum of their scores, given the word. logp and scores have an entry more, for edge -1: no piece."""
    one = np.zeros(len(edges[0]))
    a, k, t = [one], [one], [one]
    some = [(e >= 0).any(0) for e in edges]
    for j in range(1, n + 1):
        sizes = [s for s in range(1, min(j, len(edges)) + 1) if some[s - 1][j - s]]
        at = [edges[s - 1][:, j - s] for s in sizes]
        parts = np.stack([a[j - s] + logp[e] for s, e in zip(sizes, at, strict=True)])
        top = parts.max(0)
        w = np.exp(parts - top)
        total = w.sum(0)
        a.append(top + np.log(total))
        if scores is not None:
            w /= total
            k.append(sum(x * k[j - s] for x, s in zip(w, sizes, strict=True)) + 1)
            t.append(sum(x * (t[j - s] + scores[e]) for x, s, e in zip(w, sizes, at, strict=True)))
    return (a[n], k[n], t[n]) if scores is not None else a[n]


def forward_long(lattice, word: bytes, logp, scores, window: int = 1 << 15):
    """What forward() gives for one word of any length, in memory that does not grow with it but for the word itself: a ring
    holds the sums that still have pieces to come."""
    x, n, ring = np.frombuffer(word, np.uint8), len(word), lattice.longest + 1
    coming: list[list] = [[] for _ in range(ring)]
    coming[0].append((0.0, 0.0, 0.0))

    def settle(i):
        terms = coming[i % ring]
        coming[i % ring] = []
        top = max(t[0] for t in terms)
        w = [math.exp(t[0] - top) for t in terms]
        total = sum(w)
        return top + math.log(total), sum(u * t[1] for u, t in zip(w, terms, strict=True)) / total, sum(u * t[2] for u, t in zip(w, terms, strict=True)) / total

    for begin in range(0, n, window):
        found = lattice.edges(x[None, begin : begin + window + lattice.longest - 1])
        size, start = [], []
        for s, e in enumerate(found, 1):
            i = np.nonzero(e[0, :window] >= 0)[0]
            start.append(i)
            size.append(np.full(len(i), s))
        start, size = np.concatenate(start), np.concatenate(size)
        order = np.argsort(start, kind="stable")
        start, size = start[order], size[order]
        piece = np.array([found[s - 1][0, i] for s, i in zip(size.tolist(), start.tolist(), strict=True)])
        now = -1
        for i, s, w, c in zip(start.tolist(), size.tolist(), logp[piece].tolist(), scores[piece].tolist(), strict=True):
            if i != now:
                now, (a, k, t) = i, settle(begin + i)
            coming[(begin + i + s) % ring].append((a + w, k + 1, t + c))
    return settle(n)


def split_weights(counts, first, stop: float):
    """Log weights of pieces: those that begin a word sum to one, the others to what the end of a word leaves."""
    out = np.log(counts)
    out[first] -= np.log(counts[first].sum())
    out[~first] += math.log1p(-stop) - np.log(counts[~first].sum())
    return out


def uses(lattice, words: list[bytes], logp) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, by forward and backward recursion. Words of more than
    LONG bytes count in stretches of that length."""
    stretches = [w[i : i + LONG] for w in words for i in range(0, len(w), LONG)]
    out, table = np.zeros(len(logp)), np.append(logp, -np.inf)
    for _, x in by_length(stretches):
        edges, n = lattice.edges(x), x.shape[1]
        some = [(e >= 0).any(0) for e in edges]

        def total(parts):
            top = np.max(parts, 0)
            return top + np.log(np.exp(np.stack(parts) - top).sum(0))

        a, b = np.zeros((2, n + 1, len(x)))
        for j in range(1, n + 1):
            a[j] = total([a[j - s] + table[edges[s - 1][:, j - s]] for s in range(1, min(j, len(edges)) + 1) if some[s - 1][j - s]])
        for j in range(n - 1, -1, -1):
            b[j] = total([b[j + s] + table[edges[s - 1][:, j]] for s in range(1, min(n - j, len(edges)) + 1) if some[s - 1][j]])
        for s, e in enumerate(edges, 1):
            row, at = np.nonzero(e >= 0)
            if len(row):
                piece = e[row, at]
                out += np.bincount(piece, np.exp(a[at, row] + logp[piece] + b[at + s, row] - a[n, row]), len(out))
    return out


def by_length(words: list[bytes], most: int = 1 << 17):
    """Indexes of words of one length up to LONG and their bytes as rows, some at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    order = order[size[order] <= LONG]
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cut):
        if len(group) and size[group[0]]:
            n = int(size[group[0]])
            step = max(1, most // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)


def likelihoods(lattice, words: list[bytes], logp, scores, moments: bool = False):
    """Of each word the log of its marginal probability, and with moments its expected pieces and sum of scores."""
    out, logp, scores = np.zeros((3, len(words))), np.append(logp, -np.inf), np.append(scores, 0.0)
    for part, x in by_length(words):
        out[: 3 if moments else 1, part] = forward(lattice.edges(x), logp, x.shape[1], scores if moments else None)
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[:, i] = forward_long(lattice, w, logp, scores)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, passes: int = 3, sharpness: float | None = None, zipf: bool = True, model: str = MODEL, block_bytes: int = 24 << 20, learn: bool = False) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens: words of other than ASCII white space, A-Z in lower case, then one end. Documents of fold 0 teach nothing; a
    null id is in fold 0. base_score: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))); c, N, V from training
    tokens. score: log10 of the marginal probability under the lattice model, whose sharpness `passes` passes over all
    training words fit unless it is given; zipf: as in pieces(); learn: `passes` passes over the distinct training words fit
    the weight of every piece instead, and training words are edges (see above). Null counts as empty, whose only token is the end. Rows that repeat an id or a
    text count and are scored each. Without training documents the sharpness is 1 and one piece in a hundred is an
    end. Empty input gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lattice")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t")).withColumn("held", held_out("id", folds))
    id_type = rows.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(rows.schema["id"].dataType)
    names = ["block", "lid", "token", "train", "ids", "held", "sizes", "lids", "counts"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(arrow_id), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def block(batches):
        part, k = TaskContext.get().partitionId(), 0
        numbers, ids, held, lids, counts, used = Numbers(), [], [], [], [], 0

        def flush():
            nonlocal numbers, ids, held, lids, counts, used, k
            train = np.zeros(len(numbers), np.int64)
            for h, i, c in zip(held, lids, counts, strict=True):
                if not h:
                    train[i] += c
            at = (part << 24) + k
            packed = [np.concatenate(x or [np.zeros(0, np.int32)]).astype(np.int32).tobytes() for x in (lids, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([at, None, None, None, ids, held, [len(x) for x in lids], *packed], types, strict=True)], names=names)
            tokens = list(numbers)
            for s in range(0, len(tokens), 50_000):
                t = tokens[s : s + 50_000]
                cols = [pa.array(np.full(len(t), at)), pa.array(np.arange(s, s + len(t), dtype=np.int32)), pa.array(t, pa.binary()), pa.array(train[s : s + len(t)])]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(t), x) for x in types[4:])], names=names)
            numbers, ids, held, lids, counts, used, k = Numbers(), [], [], [], [], 0, k + 1

        rows = ((i, t, h) for b in batches for p in by_bytes(b.column(1)) for i, t, h in zip(*(b.column(c).slice(p.offset - b.column(1).offset, len(p)).to_pylist() for c in range(3)), strict=True))
        for i, t, h in rows:
            w = np.fromiter(map(numbers.__getitem__, (t or b"").lower().split()), np.int32)
            u, c = np.unique(w, return_counts=True)
            ids.append(i)
            held.append(h)
            lids.append(u)
            counts.append(c)
            used += len(t or b"")
            if used >= block_bytes:
                yield from flush()
        if ids:
            yield from flush()

    blocks = scratch.table(rows.mapInArrow(block, f"block long, lid int, token binary, train long, ids array<{id_type}>, held array<boolean>, sizes array<int>, lids binary, counts binary"), "blocks")
    tokens = blocks.filter("token is not null").select("block", "lid", "token", "train")
    words = scratch.table(tokens.groupBy("token").agg(F.sum("train").alias("c")), "words")
    n_docs = rows.filter(~F.col("held")).count()
    stats = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n_train, v_train = stats["n"] + n_docs, stats["v"] + (n_docs > 0)
    norm = np.log10(n_train + 0.1 * (v_train + 1))

    surfaces, scores = pieces(model, zipf)
    sent, given = spark.sparkContext.broadcast((surfaces, scores)), sharpness is not None
    sharpness, log_end = sharpness if given else 1.0, math.log(0.01)
    for _ in range(0 if learn else passes if stats["n"] and not given else bool(stats["n"])):
        now = log_weights(scores, sharpness)
        now = spark.sparkContext.broadcast(now)

        def expect(batches, now=now):
            surfaces, scores = sent.value
            lattice, sums = Lattice(surfaces), np.zeros(2)
            for b in batches:
                for t in by_bytes(b.column(0)):
                    out = likelihoods(lattice, [b" " + w for w in t.to_pylist()], now.value, scores, True)
                    sums += out[1:] @ b.column(1).slice(t.offset - b.column(0).offset, len(t)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=["k", "s"])

        got = words.filter("c > 0").select("token", "c").mapInArrow(expect, "k double, s double").agg(F.sum("k"), F.sum("s")).first()
        if not given:
            sharpness = sharpness_of(scores, got[1] / got[0])
        log_end = math.log(n_docs / (n_docs + got[0]))
    if not stats["n"] and n_docs:
        log_end = math.log(n_docs / (n_docs + 1))
    if learn:
        first = np.array([s.startswith(b" ") for s in surfaces])
        stop, counts = 0.5, np.exp(log_weights(scores, sharpness))
        for _ in range(passes if stats["v"] else 0):
            now = spark.sparkContext.broadcast(split_weights(counts, first, stop))

            def count(batches, now=now):
                lattice, sums = Lattice(sent.value[0]), np.zeros(len(now.value))
                for b in batches:
                    for t in by_bytes(b.column(0)):
                        sums += uses(lattice, [b" " + w for w in t.to_pylist()], now.value)
                used = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["piece", "k"])

            got = words.filter("c > 0").select("token").mapInArrow(count, "piece int, k double").groupBy("piece").agg(F.sum("k").alias("k")).toPandas()  # a row for each piece
            counts = np.full(len(surfaces), RARE)
            counts[got["piece"].to_numpy()] += got["k"].to_numpy()
            stop = stats["v"] / (stats["v"] + counts[~first].sum())
        if n_docs and stats["n"]:
            log_end = math.log(n_docs / n_train)
        less = min(0.95, max(0.1, stats["once"] / max(1, stats["once"] + 2 * stats["twice"])))
        weights, goes_on = split_weights(counts, first, stop), math.log1p(-math.exp(log_end))
        spelt = goes_on + math.log(stop) + (math.log(less * stats["v"] / stats["n"]) if stats["n"] else 0.0)
    else:
        weights = log_weights(scores, sharpness) + math.log1p(-math.exp(log_end))
    last = spark.sparkContext.broadcast(weights)

    def weigh(batches):
        surfaces, scores = sent.value
        lattice = Lattice(surfaces)
        for b in batches:
            for t in by_bytes(b.column(0)):
                c = b.column(1).slice(t.offset - b.column(0).offset, len(t))
                out = likelihoods(lattice, [b" " + w for w in t.to_pylist()], last.value, scores)[0]
                if learn:
                    kept = np.maximum(c.to_numpy() - less, 0)
                    whole = np.log(kept, out=np.full(len(kept), -np.inf), where=kept > 0) - math.log(max(1, stats["n"]))
                    out = np.logaddexp(out + spelt, whole + goes_on)
                yield pa.RecordBatch.from_arrays([t, c, pa.array(out / np.log(10))], names=["token", "c", "p"])

    weighed = words.mapInArrow(weigh, "token binary, c long, p double")
    values = tokens.select("block", "lid", "token").join(weighed, "token").select("block", "lid", "c", "p")
    packed = blocks.filter("token is null").select(F.col("block").alias("b"), "ids", "held", "sizes", "lids", "counts")
    end_base, end_score = float(np.log10(n_docs + 0.1) - norm), float(log_end / np.log(10))
    out_schema = pa.schema([("id", arrow_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema.empty_table()
        row = left.slice(0, 1).to_pylist()[0]
        size = np.array(row["sizes"], np.int64)
        lid, n = np.frombuffer(row["lids"], np.int32), np.frombuffer(row["counts"], np.int32).astype(float)
        c, p = np.zeros(right.num_rows), np.zeros(right.num_rows)
        at = right["lid"].to_numpy()
        c[at], p[at] = right["c"].to_numpy(), right["p"].to_numpy()
        doc = np.repeat(np.arange(len(size)), size)
        add = lambda x: np.bincount(doc, x, len(size)) if len(lid) else np.zeros(len(size))
        known = (add(n * (c[lid] > 0)) + (n_docs > 0)).astype(np.int64)
        base = add(n * (np.log10(c[lid] + 0.1) - norm)) + end_base
        cols = [pa.array(row["ids"], arrow_id), pa.array(row["held"]), pa.array((add(n) + 1).astype(np.int64)), pa.array(known), pa.array(base), pa.array(add(n * p[lid]) + end_score)]
        return pa.Table.from_arrays(cols, schema=out_schema)

    out = packed.groupBy("b").cogroup(values.groupBy("block")).applyInArrow(total, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")
