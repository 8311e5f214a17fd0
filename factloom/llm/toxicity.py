"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct single words, pairs of neighbours and pairs one word apart, hashed to 2^20 places. FTRL-proximal
keeps a learning rate for each place and sets places of little evidence to exactly zero, so the weights are a short list,
which is broadcast; scoring looks at whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, by_bytes, held_out, packed, small_batches, unpacked
from factloom.llm.minhash import Hashes, P, mix64

BITS = 20
#: A-Z to a-z, other ASCII than letters and digits to space; bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PAIR, SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def places(text: bytes | None, hashes: Hashes):
    """Places of all n-grams and skip-grams of a text, repeats included."""
    h = np.array([hashes[w] for w in (text or b"").translate(PLAIN).split()], np.uint64)
    parts = [h, mix64(h[:-1] * PAIR + h[1:]), mix64((h[:-2] * SKIP + h[2:]) ^ P)]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; place -1 of w is the bias, which no L1 shrinks."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at, y: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-min(30.0, max(-30.0, w.sum())))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", folds: int = 5, sample: int = 5000, sample_bytes: int = 24 << 20, passes: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias. Learns from labelled ids outside fold 0: of each class, in the order of a hash of the id,
    the first `sample` ids, and of these as many as have `sample_bytes` of text together, the first whatever its length.
    An id of several labels is toxic if one is, and of several texts the smallest stands for it. Rows of null id or null
    label teach nothing. Without an example of either class all weights are empty. One task learns, as FTRL takes one
    example after the other; the driver sees weights only.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{target}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter(~held_out("id", folds))
    rate = {x["y"]: x["count"] for x in known.groupBy("y").count().collect()}
    if len(rate) < 2:
        return NOTHING
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    drawn = scratch.table(drawn[0].unionByName(drawn[1]), "drawn")  # 2 * sample rows of two numbers at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    texts = texts.select("y", F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("id"), F.octet_length("t").alias("n"), places_udf()(F.col("t").cast("binary")).alias("f"))
    examples = scratch.table(texts, "examples")
    taken = F.lit(False)
    listed = sorted(map(tuple, examples.select("y", "h", "id", "n").collect()))  # 2 * sample rows of four numbers at most
    for y in (0, 1):
        used, last = 0, None
        for _, h, i, n in (x for x in listed if x[0] == y):
            if used >= sample_bytes:
                break
            used, last = used + n, (h, i)
        if last:
            taken = taken | (F.col("y") == y) & ((F.col("h") < last[0]) | (F.col("h") == last[0]) & (F.col("id") <= last[1]))
    taken = examples.filter(taken)

    def learn(batches):
        got = [(h, i, y, np.frombuffer(f, np.int32)) for b in batches for y, h, i, f in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)]
        got.sort(key=lambda x: x[:2])
        n1 = sum(x[2] for x in got)
        if not 0 < n1 < len(got):  # labels without documents
            return
        model = Ftrl()
        for _ in range(passes):
            for _, _, y, f in got:
                model.learn(f, y)
        w = model.weights(np.arange((1 << BITS) + 1))
        prior = np.log(rate[1] / rate[0]) - np.log(n1 / (len(got) - n1))  # the sample holds the classes in other shares
        w[-1] += prior
        at = np.nonzero(w)[0].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["i", "w"])

    got = taken.select("y", "h", "id", "f").coalesce(1).mapInArrow(learn, "i int, w double").collect()  # the weights, 2^20 at most
    scratch.drop()
    if not got:
        return NOTHING
    at, w = (np.array(x) for x in zip(*sorted(map(tuple, got)), strict=True))
    bias = float(w[-1]) if at[-1] == 1 << BITS else 0.0
    return at[at < 1 << BITS].astype(np.int32), w[at < 1 << BITS], bias


NOTHING = np.zeros(0, np.int32), np.zeros(0), 0.0


def places_udf():
    @F.arrow_udf("binary")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for part in (p for whole in texts for p in by_bytes(whole)):
            yield pa.array([np.unique(places(t, hashes)).tobytes() for t in part.to_pylist()], pa.binary())

    return features


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None, folds: int = 5, as_row: bool = False) -> DataFrame:
    """One row per row of docs: id, payload, held_out, score (0 to 1), predicted (1 from 0.5 on); with as_row the id and the
    payload as a struct `row`, else a payload of a result's name is left out.

    Null and empty texts have the score of the bias alone. A model without weights scores 0. A null id is in fold 0. Rows
    that repeat an id are scored each by its own text; equal texts have equal scores. Empty input gives no rows. Only the
    text goes to Python, once, and only the score comes back.
    """
    at, weights, bias = model
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights))  # 2^20 weights at most

    @F.arrow_udf("double")
    def apply(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, weights = sent.value
        table, hashes = np.zeros(1 << BITS), Hashes()
        table[at] = weights
        for part in (p for whole in texts for p in by_bytes(whole)):
            out = []
            for t in part.to_pylist():
                p = places(t, hashes)
                out.append(table[np.unique(p[table[p] != 0])].sum() + bias)
            s = 1 / (1 + np.exp(-np.clip(np.array(out, float), -700, 700)))
            yield pa.array(s if len(at) else np.zeros(len(s)))

    rows = docs.select(packed(docs, id_col, payload), apply(F.col(f"`{text_col}`").cast("binary")).alias("s"))
    rows = rows.withColumn("id", F.col(f"row.`{id_col}`"))
    return unpacked(rows, [held_out("id", folds).alias("held_out"), F.col("s").alias("score"), (F.col("s") >= 0.5).cast("int").alias("predicted")], as_row)
