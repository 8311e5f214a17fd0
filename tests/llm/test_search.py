"""Name join, substring dedup and ranked search against plain Python, with nulls, empty and long values, ties, repeats and
clashing columns."""

import gc
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from factloom.llm import name_join, queries, ranked, repeats
from factloom.llm.common import Scratch


def damerau(x, y):
    """The whole table of the unrestricted distance."""
    far, seen = len(x) + len(y), {}
    d = {(i, -1): far for i in range(-1, len(x) + 1)} | {(-1, j): far for j in range(-1, len(y) + 1)}
    d |= {(i, 0): i for i in range(len(x) + 1)} | {(0, j): j for j in range(len(y) + 1)}
    for i in range(1, len(x) + 1):
        last = 0
        for j in range(1, len(y) + 1):
            a, b = seen.get(y[j - 1], 0), last
            if x[i - 1] == y[j - 1]:
                last = j
            d[i, j] = min(d[i - 1, j - 1] + (x[i - 1] != y[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1, d[a - 1, b - 1] + (i - a - 1) + 1 + (j - b - 1) if a and b else far)
        seen[x[i - 1]] = i
    return d[len(x), len(y)]


def edited(r, x):
    x = list(x)
    for _ in range(r.randint(0, 3)):
        i, way = r.randrange(len(x) + 1), r.randrange(4)
        if way == 0:
            x.insert(i, r.choice("abcdé"))
        elif i < len(x) and way == 1:
            x.pop(i)
        elif i < len(x) and way == 2:
            x[i] = r.choice("abcd")
        elif i + 1 < len(x):
            x[i], x[i + 1] = x[i + 1], x[i]
    return "".join(x)


def name(r, most):
    return "".join(r.choice(["a", "b", "ab", "ca", "é", "😀", "dd"]) for _ in range(r.randint(0, most)))


def test_distance():
    r = random.Random(2)
    assert name_join.distance("ca", "abc", 2) == 2  # exchanged, then c put between
    for _ in range(1500):
        x = name(r, 7)
        y = edited(r, x)
        want = damerau(x, y)
        for k in range(4):
            assert name_join.distance(x, y, k) == (want if want <= k else None), (x, y, k)


@pytest.mark.parametrize("k", [1, 2])
def test_join_names(spark, k):
    r = random.Random(k)
    left = [name(r, 11) for _ in range(90)] + [None, "", "x" * 4000]
    right = [edited(r, x) for x in left if x is not None] + [name(r, 5) for _ in range(40)] + [None, "", "x" * 2000 + "y" + "x" * 1999]
    frame = lambda names: spark.createDataFrame([(n, 1) for n in names], "name string, nid int")  # noqa: E731  (an own column's name)
    got = [tuple(x) for x in name_join.join_names(frame(left), frame(right), k).collect()]
    near = lambda x, y: name_join.distance(x, y, k) if len(x) > 100 else damerau(x, y)
    want = {(x, y, near(x, y)) for x in set(left) for y in set(right) if x and y and abs(len(x) - len(y)) <= k and (near(x, y) or 0) <= k and near(x, y) is not None}
    assert len(got) == len(set(got)) and set(got) == want
    assert ("x" * 4000, "x" * 2000 + "y" + "x" * 1999, 1) in want
    assert name_join.join_names(frame([]), frame(right), k).count() == name_join.join_names(frame(left), frame([None]), k).count() == 0


def test_name_query(spark, tmp_path):
    clients = [(1, "Ann Lee"), (2, "ANNLEE"), (3, "Anne Lee"), (4, "Ane Lee"), (5, None), (6, " \t"), (2, "ANNLEE"), (None, "Ann Lee")]
    vendors = [(7, "Ann Lee"), (8, "Ann Lee"), (None, "Ann Lee"), (9, None), (10, ""), (8, "Ann Lee"), (11, "A")]
    for t, rows, i in (("clients", clients, "client_id"), ("vendors", vendors, "vendor_id")):
        spark.createDataFrame([(*r, "clash") for r in rows], f"{i} long, name string, distance string").write.parquet(f"{tmp_path}/{t}.parquet")
    got = sorted(map(tuple, queries.op11_name_join(spark, str(tmp_path)).collect()), key=str)
    import zlib

    def misspelt(i, n):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        j = h % max(1, len(n) - 1)
        return n[:j] + n[j + 1] + n[j] + n[j + 2 :] if h % 2 == 0 and len(n) > 1 else n

    low = lambda n: re.sub(r"[\x20\x09-\x0d]", "", n).translate({c: c + 32 for c in range(65, 91)})
    want = []
    for v, n in vendors:
        by = defaultdict(list)
        for c, m in clients:
            if n and m and low(n) and low(m) and damerau(low(misspelt(v, n)), low(m)) <= 1:
                by[damerau(low(misspelt(v, n)), low(m))].append(c)
        want += [(v, d, len(x), min(c for c in x if c is not None), sum(zlib.crc32(str(c).encode()) for c in x if c is not None)) for d, x in by.items()]
    assert got == sorted(want, key=str) and len(got) > 4


def plain_repeats(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    key = lambda i: math.inf if i is None else i
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - k + 1):
            s = tuple(w[j : j + k])
            first[s] = min(first.get(s, math.inf), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j + o for j in range(len(w) - k + 1) for o in range(k) if first[tuple(w[j : j + k])] < key(i)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [2, 5, 13, 12])
def test_repeats(spark, k):
    r = random.Random(k)
    word = lambda n: " ".join(r.choice(["a", "b", "c", "Über", "x1"] if k < 6 else ["w%d" % i for i in range(40)]) for _ in range(n))
    shared = [word(n) for n in (k - 1, k, k + 1, 2 * k, 40)]
    rows = [(i, f"{word(r.randint(0, 30))}\n{r.choice(shared)}\t{word(r.randint(0, 9))} {r.choice(shared)}") for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (70, None), (71, ""), (72, " \n\t"), (None, rows[5][1]), (None, rows[5][1]), (73, " ".join([rows[6][1]] * 40)), (74, word(9000)), (-5, shared[4]), (75, (shared[3] + " ") * 3)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, kept string, n long").repartition(3)
    for size in (8 << 20, 300):
        got = repeats.repeats(docs, window=k, batch_bytes=size, part_bytes=12 << 20 if size > 300 else 2000)
        out = [(x.doc_id, x.n_words, sum(s.end - s.start for s in x.spans), x.kept) for x in got.collect()]
        assert sorted(out, key=str) == plain_repeats(rows, k)
    assert any(n for _, _, n, _ in out)
    assert all(a.end < b.start for x in got.collect() for a, b in zip(x.spans, x.spans[1:], strict=False))
    assert repeats.repeats(docs.limit(0), window=k).count() == 0


def plain_ranking(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total, df = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 10 + 90 * b.total() * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_ranked(spark):
    r = random.Random(4)
    vocabulary = [f"t{i}" for i in range(80)] + ["É", "日本", "x_y", "A-b", "Don't"]
    text = lambda n: " ".join(vocabulary[min(len(vocabulary) - 1, int(r.expovariate(0.06)))] + r.choice(["", ".", ","]) for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 30, 120]))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (500, None), (501, ""), (502, "-- !"), (503, text(20000)), (504, docs[8][1].upper())]
    items = [(i, text(r.choice([1, 3, 25]))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, docs[7][1]), (93, docs[7][1]), (None, "t1 t2"), (94, "t0 " * 50)]
    d = spark.createDataFrame([(*x, "clash", 5) for x in docs], "doc_id long, text string, item_id string, score long").repartition(3)
    q = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    for k, size in ((10, 4 << 20), (3, 200)):
        got = ranked.search(d, q, k=k, query_bytes=size)
        assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items, k)
    assert ranked.search(d.limit(0), q).count() == ranked.search(d, q.limit(0)).count() == ranked.search(d.filter("doc_id in (500, 502)"), q).count() == 0


def test_segments_agree(spark):
    """Few or many documents in a segment: the same index, in impact order."""
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} common " * (i % 5)) for i in range(200)], "doc_id long, text string").coalesce(1)
    for size in (1 << 20, 500):
        index, df, n = ranked.build(docs, Scratch(spark, "t"), segment_bytes=size)
        assert n == 160 and df.filter("term = 'common'").first().df == 160
        for row in index.collect():
            assert row.terms == sorted(row.terms)
            groups = memoryview(row.impacts).cast("I").tolist()
            for a, z in zip([0, *row.ends], row.ends, strict=False):
                assert groups[a:z] == sorted(set(groups[a:z]), reverse=True)
    assert index.count() > 1


def test_segments_are_read_one_at_a_time(spark):
    """A file of several segments would be in memory whole, however large its task's input is."""
    docs = spark.createDataFrame([(i, f"a{i} b{i % 3} " * 9) for i in range(120)], "doc_id long, text string").coalesce(1)
    index, _, _ = ranked.build(docs, Scratch(spark, "t"), segment_bytes=500)
    assert len(index.inputFiles()) == index.count() > 5


def test_segments_leave_nothing_behind():
    """A task makes many segments: the terms of one go with it, not when Python looks for cycles."""
    gc.collect()
    gc.disable()
    try:
        ranked.segment(pa.array([1, 2]), [pa.array([b"left one", b"left two"])])
        assert not [x for x in gc.get_objects() if isinstance(x, defaultdict) and b"left" in x]
    finally:
        gc.enable()


def test_early_stop():
    """Documents that only a term of small weight has are given up; the best have whole scores."""
    import numpy as np

    docs, starts, ends = np.concatenate([np.arange(12), np.arange(5000)]), np.array([0, 12]), np.array([12, 5012])
    d, s = ranked.best([(np.array([1000]), np.array([0])), (np.array([1]), np.array([1]))], 5000, 3, docs, starts, ends, step=4)
    assert d.tolist() == list(range(12)) and set(s.tolist()) == {1001}
