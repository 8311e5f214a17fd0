"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Spaces become marks, one mark goes in front, and a text is cut before each run of marks: no piece of the vocabulary holds
a mark after another character, so the best segmentation of a text is that of its marked words, side by side. The
distinct marked words of a block are sorted, which lists the leaves of their trie in depth-first order; the forward
scores of the characters that a word shares with the one before it are still on the stack and are not computed again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, small_batches
from factloom.llm.vocabulary import MARK, MODEL, Vocabulary, load

MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Stands for a mark that the text itself holds, so that decoding gives it back: no UTF-8 text has a lone surrogate.
OWN = "\udc81"


def marked(text: str) -> list[str]:
    """The marked words of a text."""
    return MARKED.findall(MARK + text.replace(MARK, OWN).replace(" ", MARK)) if text else []


class Segmenter:
    """Best segmentations: largest sum of scores; of equal sums the one whose last piece is longest, and so on backwards.
    A character that no piece has costs vocabulary.unknown and is written as byte pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.root = vocabulary, {}
        for piece, i in vocabulary.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (i, vocabulary.scores[i])

    def segment(self, words: list[str]):
        """ids of all words, one after the other, and where each word's begin; words are sorted and distinct.

        Only the open pieces at places that the next word shares are kept, so a word costs 16 bytes a character.
        """
        root, unknown, byte_ids = self.root, self.v.unknown, self.v.byte_ids
        best, origin, by, active, same = array("d", [0.0]), array("i", [0]), array("i", [-1]), [[]], 0
        flat = array("i")
        starts = np.zeros(len(words) + 1, np.int64)
        for k, word in enumerate(words):
            del best[same + 1 :], origin[same + 1 :], by[same + 1 :], active[same + 1 :]
            begin, after = same, words[k + 1] if k + 1 < len(words) else ""
            same, most = 0, min(len(word), len(after))
            while same < most and word[same] == after[same]:
                same += 1
            for d in range(begin, len(word)):
                c, top, last, used, now = word[d], None, 0, -1, []
                for start, node in active[d]:
                    if c in node:
                        node = node[c]
                        now.append((start, node))
                        if "" in node:
                            i, s = node[""]
                            if top is None or best[start] + s > top:
                                top, last, used = best[start] + s, start, i
                node = root.get(c)
                if node is not None:
                    now.append((d, node))
                if node is not None and "" in node:
                    i, s = node[""]
                    if top is None or best[d] + s > top:
                        top, last, used = best[d] + s, d, i
                elif top is None or best[d] + unknown > top:
                    top, last, used = best[d] + unknown, d, -1
                best.append(top)
                origin.append(last)
                by.append(used)
                active.append(now)
                if d > same:
                    active[d] = None
            at, out = len(word), array("i")
            while at:
                i, at = by[at], origin[at]
                out.extend((i,) if i >= 0 else reversed([byte_ids[b] for b in (MARK if word[at] == OWN else word[at]).encode()]))
            out.reverse()
            flat.extend(out)
            starts[k + 1] = len(flat)
        return np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), starts


class Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def encode_block(texts: list[str | None], segmenter: Segmenter):
    """ids of each text, None of None."""
    numbers, rows = Numbers(), []
    for t in texts:
        rows.append(None if t is None else np.fromiter(map(numbers.__getitem__, marked(t)), np.int64))
    words = sorted(numbers)
    flat, starts = segmenter.segment(words)
    place = np.empty(len(words), np.int64)
    place[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    for r in rows:
        if r is None:
            yield None
            continue
        at = place[r]
        n = starts[at + 1] - starts[at]
        yield flat[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def decode_ids(ids, surface: list[bytes]) -> str:
    return b"".join(map(surface.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = MODEL, block_bytes: int = 4 << 20) -> DataFrame:
    """docs and `out_col`, the ids of each whole text; null of null, none of empty texts. A column of that name is replaced.

    Rows are coded one by one: of repeated rows and equal texts each gets the same ids. Empty input gives no rows. Words
    share prefixes within a block of about block_bytes of texts, or one longer text. Only the text goes to Python, once.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(load(model)))

    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segmenter = Segmenter(Vocabulary(*sent.value))
        for part in (p for whole in texts for p in by_bytes(whole, block_bytes)):
            flat, sizes, null = [np.zeros(0, np.int32)], [0], []
            for x in encode_block(part.to_pylist(), segmenter):
                null.append(x is None)
                sizes.append(0 if x is None else len(x))
                if x is not None:
                    flat.append(x)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(flat), pa.int32()), mask=pa.array(null, pa.bool_()))

    return docs.withColumn(out_col, run(F.col(f"`{text_col}`")))


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """docs and `out_col`, the text of each list of ids; null of null. A column of that name is replaced. Rows are decoded one
    by one, repeated ones too. Empty input gives no rows."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(load(model).surface)

    @F.arrow_udf("string")
    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in lists:
            at, flat, null = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False), a.is_null().to_pylist()
            yield pa.array((None if null[i] else decode_ids(flat[at[i] : at[i + 1]], sent.value) for i in range(len(a))), pa.string())

    return docs.withColumn(out_col, run(F.col(f"`{ids_col}`")))
