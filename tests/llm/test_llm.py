"""The corpus operators against plain Python on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import shutil
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import embed_dedup, exact_dedup, html_layout, lattice, minhash, mixing, pieces, sharding, toxicity, vocabulary, warc
from factloom.llm.common import Scratch
from factloom.llm.components import components

DOCS = "doc_id long, text string, source string, row string, id string"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "an", "thonder", "Über", "x1", "gain", "stone", "river", "idea"]) + rng.choice(["", ".", "s"]) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [words(rng, 60) for _ in range(12)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20 + i, base[i].replace(" ", "\n ") + " ", "s0") for i in range(4)]  # equal but for white space
    near = base[5].split()
    near[10] = "changed"
    rows += [(30, " ".join(near), "s1"), (31, base[5].upper(), "s1"), (32, None, None), (33, "", "s2"), (34, " \t\n", None), (35, "two words", "s0"), (36, "Two  Words", "s0")]
    rows += [(40, words(rng, 9000), "s2"), (0, base[0], "s0"), (None, "no id " + base[1], "s1"), (None, None, None)]
    return [(*r, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def plain(t):
    return "".join(t.split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}) if t else ""


def test_exact(docs, none):
    groups = {}
    for r in corpus():
        groups.setdefault(plain(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    want = []
    for t, g in groups.items():
        want += [(m[3], min(g)[3], len(g), hashlib.sha256(t.encode()).hexdigest()) for m in g]
    for first, growth in ((32, 16), (2, 3)):
        got = exact_dedup.exact_groups(docs, first=first, growth=growth)
        assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=str)
        assert got.filter("kept").count() == len(groups)
    kept = exact_dedup.exact_groups(docs, payload=docs.columns).filter("kept")
    assert set(docs.columns) <= set(kept.columns)
    assert {plain(r["text"]) for r in kept.collect()} == set(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows):
    sets, up = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def test_minhash(spark, docs, none):
    assert tuples(minhash.near_groups(docs), "doc_id", "n_shingles", "component_id") == near_brute(corpus())
    assert minhash.near_groups(none).count() == 0
    rng = random.Random(8)  # a hub, copies that link with it and seldom with each other, and their own chain
    hub = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(hub)
        for k in rng.sample(range(200), 5 if i else 0):
            w[k] = f"c{i}_{k}"
        rows.append((500 - i, " ".join(w)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), near_brute(rows)
    for pivot_from, block_rows, block_bytes in ((8, 256, 1 << 21), (2, 7, 1 << 21), (10_000, 256, 4096)):
        got = minhash.near_groups(df, pivot_from=pivot_from, block_rows=block_rows, block_bytes=block_bytes)
        assert tuples(got, "doc_id", "n_shingles", "component_id") == want


def test_settings_of_the_session(spark):
    from types import SimpleNamespace

    from factloom.llm import common

    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for given, after in (("64m", common.BATCH), ("1m", 1 << 20), ("4194304b", 4 << 20)):
        spark.conf.set(key, given)
        common.small_batches(spark)
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) == after
    spark.conf.set(key, before)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="local-cluster[3,2,3000]"))
    with pytest.raises(ValueError, match="all executors share"):
        common.shared_root(cluster)


def test_slices_of_bytes():
    import pyarrow as pa

    from factloom.llm.common import by_bytes

    values = pa.array(["x" * 10, None, "", "y" * 50, "z" * 3, "w" * 3])
    for a in (values, values.cast(pa.large_string()), pa.array(["skip", *values.to_pylist()]).slice(1)):
        assert [p.to_pylist() for p in by_bytes(a, 12)] == [["x" * 10, None, ""], ["y" * 50], ["z" * 3, "w" * 3]]
    assert list(by_bytes(pa.array([], pa.string()))) == []


def test_minmax_is_unbiased():
    rng = np.random.default_rng(1)
    m, got = minhash.MinMax(100, 6, 3), []
    for k in range(20):
        x = rng.integers(0, 1 << 63, 300, np.uint64)
        got.append((m.signature(x[:240]) == m.signature(x[60:])).mean())
    assert abs(np.mean(got) - 0.6) < 0.02


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert {r["v"]: r["c"] for r in got} == {v: root(v) for a, b in links if a != b for v in (a, b)}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base, rows = rng.normal(size=(6, 16)), []
    for i in range(90):
        v = base[i % 6] + rng.normal(size=16) * (0.25 if i % 2 else 0.5)
        rows.append((i, v.astype(np.float32).tolist(), i % 2 or None if i > 80 else i % 2))
    rows += [(100, rows[4][1], 0), (101, rows[4][1], 1), (4, rows[4][1], 0), (102, None, 0), (103, [0.0] * 16, 0), (104, [math.nan] + [1.0] * 15, 0), (105, [None] + [1.0] * 15, 0), (106, [1.0, 2.0], 0), (107, [], 1), (None, rows[4][1], 0)]
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    x = [np.array(r[1], float) if o else None for r, o in zip(rows, ok, strict=True)]
    link = [[o and p and i != j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93 for j, p in enumerate(ok)] for i, o in enumerate(ok)]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
    least = [min((rows[j][0] for j in range(len(rows)) if comp[j] == c and rows[j][0] is not None), default=None) for c in comp]
    want = sorted(((r[0], sum(map(bool, link[i])), least[i]) for i, r in enumerate(rows)), key=str)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sum(w[1] for w in want) > 50
    for block, size in ((8, 1 << 20), (1024, 1 << 20), (1024, 16 * 20)):
        assert tuples(embed_dedup.near_vectors(df, block=block, block_bytes=size), "vec_id", "n_links", "component_id") == want
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e, length = embed_dedup.quantise(x)
    error = e[:, None] * length + e
    about = (q.astype(float) @ q.astype(float).T) * s[:, None] * s
    assert (np.abs(about - x @ x.T) <= error + 1e-9).all()
    x[::3] = x[0] + rng.normal(size=x[::3].shape) * rng.random((100, 1)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = np.triu(x @ x.T >= 0.93, 1)
    sure, open_ = (np.zeros(true.shape, bool) for _ in range(2))
    for m, (p, q) in zip((sure, open_), embed_dedup.tile_links(embed_dedup.quantise(x), embed_dedup.quantise(x), 0.93, True), strict=True):
        m[p, q] = True
    assert sure.any()
    assert open_.any()
    assert (~sure | true).all()
    assert (~true | sure | open_).all()


def test_vectors_of_any_magnitude(spark):
    rows = [(0, [1e200, 2e200], 0), (1, [1e200, 2.0001e200], 0), (2, [1e-200, 2e-200], 0), (3, [5e-324, 1e-323], 0), (4, [-1e200, 2e200], 0), (5, [1.0, 2.0], 0), (6, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "vec_id long, embedding array<double>, label int, x string, kept int")
    assert tuples(embed_dedup.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == [(0, 4, 0, True), (1, 4, 0, False), (2, 4, 0, False), (3, 4, 0, False), (4, 0, 4, True), (5, 4, 0, False), (6, 0, 6, True)]


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(spark, docs, shards):
    got = sharding.shard(docs, shards).collect()
    rows = corpus()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    for k in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    by = {}
    for r in got:
        by.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    sizes = {}
    for r in rows:
        first, total = sizes.get(r[1], (None, 0))
        ids = [i for i in (first, r[0]) if i is not None]
        sizes[r[1]] = (min(ids) if ids else None, total + len((r[1] or "").encode()) + 8)
    order = [n for _, n in sorted(sizes.values(), key=lambda x: (x[0] is not None, x[0] or 0))]

    def feasible(c):
        used, room = 1, c
        for n in order:
            if n > c:
                return False
            if n > room:
                used, room = used + 1, c
            room -= n
        return used <= shards

    best = next(c for c in range(sum(order) + 1) if feasible(c)) if shards > 1 else sum(order)
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) == best


def test_cuts_refine(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 500) for _ in range(3000)]
    e = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame([(x, i + 1) for i, x in enumerate(e)], "e long, r long").cache()
    for n, points in ((7, 20), (24, 50), (24, 100000)):
        capacity, _, cut = sharding.cuts(groups, e[-1], n, points)

        def feasible(c, n=n):
            used, room = 1, c
            for s in sizes:
                if s > c:
                    return False
                if s > room:
                    used, room = used + 1, c
                room -= s
            return used <= n

        assert feasible(capacity)
        assert not feasible(capacity - 1)
        assert max(b - a for a, b in zip([0, *cut], cut, strict=False)) <= capacity
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_targets():
    got = mixing.targets({"a": 10, "b": 100, "c": 1}, {"a": 5, "b": 2, "c": 1}, 111)
    assert got["a"] == 30.0
    assert got["c"] == 3.0
    assert got["b"] == 78.0


def test_flow_prefers_fewest_repeats():
    sent = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 18, "b": 8})
    assert sum(f.get("a", 0) for f in sent.values()) == 18
    assert sum(f.get("b", 0) for f in sent.values()) == 8
    total = {p: sum(f.values()) for p, f in sent.items()}
    assert all(total[p] >= n for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 2}.items())


def test_flow_is_the_best_of_all():
    rng, costs = random.Random(7), mixing.costs_of(2)
    for _ in range(25):
        sizes = {("a",): rng.randrange(4), ("a", "b"): rng.randrange(1, 4), ("b",): rng.randrange(4)}
        quotas = {"a": rng.randrange(9), "b": rng.randrange(9)}

        def cost(n, size):
            return sum(c * min(max(n - k * size, 0), size) for k, c in enumerate(costs))

        best = None
        for x in range(2 * sizes["a",] + 1):
            for y in range(2 * sizes["a", "b"] + 1):
                for z in range(2 * sizes["a", "b"] - y + 1):
                    for w in range(2 * sizes["b",] + 1):
                        if x + y <= quotas["a"] and z + w <= quotas["b"]:
                            this = (-(x + y + z + w), cost(x, sizes["a",]) + cost(y + z, sizes["a", "b"]) + cost(w, sizes["b",]))
                            best = this if best is None else min(best, this)
        sent = mixing.flow(sizes, quotas, costs)
        assert all(sum(f.get(s, 0) for f in sent.values()) <= q for s, q in quotas.items())
        assert (-sum(n for f in sent.values() for n in f.values()), sum(cost(sum(f.values()), sizes[p]) for p, f in sent.items())) == best


def test_mixing_of_overlapping_sources(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice([["a"], ["b"], ["b", "a"], ["a", "b", "a"], ["c", "b"], [], None]), "clash", -1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>, members string, size int")
    for limit in (3, 5):
        out, stats = mixing.mix(df, F.col("of"), {"a": 1, "b": 1, "c": 40}, limit=limit, payload=["of", "members", "size"], as_row=True)
        got = out.collect()
        assert all(r["row"]["members"] == "clash" and r["row"]["size"] == -1 for r in got)
        assert {r["copies"] for r in got if not r["members"]} == {0}
        assert max(r["copies"] for r in got) == limit
        sizes = {}
        for r in got:
            sizes[tuple(r["members"])] = sizes.get(tuple(r["members"]), 0) + r["size"]
        sent = mixing.flow({p: n for p, n in sorted(sizes.items()) if p}, {s: round(t) for s, (_, t) in stats.items()}, mixing.costs_of(limit))
        for p, f in sent.items():
            assert abs(sum(r["taken"] for r in got if tuple(r["members"]) == p) - sum(f.values())) <= 30
        assert (stats["c"][1] == limit * stats["c"][0]) == (limit == 3)
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(df, F.col("of"), most_patterns=2)


def test_mixing(spark, none):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(5, 60)), rng.choice(["a", "a", "a", "b", None])) for i in range(600)] + [(900, None, "a"), (901, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, stats = mixing.mix(df, F.array("source"), payload=["source"])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len((dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "").split())
        assert 0 <= r["copies"] <= 3
        assert r["taken"] == r["size"] * r["copies"]
    for s, (size, target) in stats.items():
        assert size == sum(r["size"] for r in got if r["source"] == s)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 60
    again, _ = mixing.mix(df.repartition(5), F.array("source"))
    assert tuples(again, "doc_id", "taken") == tuples(out, "doc_id", "taken")
    two, st = mixing.mix(df, F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("e"), F.lit("all"))).otherwise(F.array(F.lit("all"))), {"e": 1, "all": 3})
    assert two.count() == len(rows)
    assert mixing.mix(none, F.array("source"))[0].count() == 0
    odd = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "x", "a"), (2, "x", "a"), (None, "y", None), (None, None, None)] + rows[:50], "doc_id long, text string, source string")
    got = mixing.mix(odd, F.array("source"))[0].collect()
    assert len(got) == 55
    assert next(r["size"] for r in got if r["doc_id"] == 1 and r["size"] > 100) == 200_000
    assert len({r["copies"] for r in got if r["doc_id"] == 2 and r["size"] == 1}) == 1


def segment_brute(word, v):
    longest = max(map(len, v.ids))
    best = [(0.0, 0, [])]
    for j in range(1, len(word) + 1):
        top = None
        for i in range(max(0, j - longest), j):
            piece = word[i:j]
            if piece in v.ids:
                cand = (best[i][0] + v.scores[v.ids[piece]], i, [v.ids[piece]])
            elif j - i == 1:
                cand = (best[i][0] + v.unknown, i, [v.byte_ids[b] for b in ("▁" if piece == pieces.OWN else piece).encode()])
            else:
                continue
            if top is None or cand[0] > top[0]:
                top = cand
        best.append(top)
    out, j = [], len(word)
    while j:
        out, j = best[j][2] + out, best[j][1]
    return out


TEXTS = ["Hello world, the thonder of  things.", "", " ", "   x", "a▁b ▁", "tab\tand\nline", "ünïcode 漢字 \U0001f600 ends ", "x" * 3000, "no break\x00nul"]


def test_pieces(spark):
    v = vocabulary.load()
    s = pieces.Segmenter(v)
    for t, ids in zip(TEXTS, pieces.encode_block(TEXTS, s), strict=True):
        assert ids.tolist() == [i for w in pieces.marked(t) for i in segment_brute(w, v)]
        assert pieces.decode_ids(ids, v.surface) == t
    df = spark.createDataFrame([(i, t, "r", [1]) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, row string, ids array<int>")
    df = df.unionByName(df)
    assert pieces.decode(pieces.encode(df.limit(0))).columns == [*df.columns, "decoded"]
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0
    got = pieces.decode(pieces.encode(df, block_bytes=50)).collect()
    assert len(got) == 2 * len(TEXTS) + 2
    assert all(r["row"] == "r" for r in got)
    assert all(r["text"] == r["decoded"] for r in got)
    assert [r["ids"] for r in got if r["text"] is None] == [None, None]


def test_no_segmentation_of_the_library_scores_better():
    """The library's merges find no larger sum of scores over the same pieces."""
    import sentencepiece

    p, v = sentencepiece.SentencePieceProcessor(model_file=vocabulary.MODEL), vocabulary.load()
    rng = random.Random(2)
    texts = [words(rng, 6) for _ in range(50)]
    total = lambda ids: sum(v.scores[i] for i in ids)
    for t, ids in zip(texts, pieces.encode_block(texts, pieces.Segmenter(v)), strict=True):
        assert total(ids.tolist()) >= total(p.encode(t))
        assert p.decode(ids.tolist()) == t


def test_lattice_sums_all_segmentations():
    surfaces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab", b"bc", b"abc"]
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(surfaces))))
    at, table = {s: i for i, s in enumerate(surfaces)}, np.append(logp, -np.inf)

    def brute(w):
        return 1.0 if not w else sum(math.exp(logp[at[w[:k]]]) * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in at)

    lat, ws, scores = lattice.Lattice(surfaces), [b" abc", b" a", b" aab", b" zzzz", b" " + b"abcab" * 80], -np.arange(len(surfaces)) * 1.0
    out = lattice.likelihoods(lat, ws, logp, scores, True)
    assert np.allclose(np.exp(out[0, :4]), [brute(w) for w in ws[:4]])

    def ways(w):
        return [[at[w[:k]], *r] for k in range(1, len(w) + 1) if w[:k] in at for r in ways(w[k:])] if w else [[]]

    for i, w in enumerate(ws[:4]):
        p = np.array([math.exp(logp[x].sum()) for x in ways(w)])
        assert np.isclose(out[1, i], (p * [len(x) for x in ways(w)]).sum() / p.sum())
        assert np.isclose(out[2, i], (p * [scores[x].sum() for x in ways(w)]).sum() / p.sum())
    for window in (7, 1 << 15):  # long words take another way to the same sums
        for i, w in enumerate(ws):
            assert np.allclose(lattice.forward_long(lat, w, table, np.append(scores, 0.0), window), out[:, i])
    x = np.frombuffer(ws[-1], np.uint8)[None]
    assert np.allclose(lattice.forward(lat.edges(x), table, len(ws[-1]), np.append(scores, 0.0)), out[:, -1:])


def test_lattice_takes_long_words():
    surfaces, scores = lattice.pieces()
    lat, began = lattice.Lattice(surfaces), time.process_time()
    word = b"abcdefghij" * 20_000
    assert lattice.likelihoods(lat, [word], lattice.log_weights(scores, 1.0), scores)[0, 0] < -len(word) / 10
    assert time.process_time() - began < 20


def test_scores_of_merges_are_ranks():
    v = vocabulary.load()
    surfaces, scores = lattice.pieces()
    at = {s: x for s, x in zip(surfaces, scores, strict=True)}
    i = v.ids["▁t"]
    assert math.isclose(at[b" t"], -math.log1p(-v.scores[i]))
    assert at[b"\xff"] == scores.min()
    given = dict(zip(*lattice.pieces(zipf=False), strict=True))
    assert (given[b" t"], given[b"\xff"]) == (v.scores[i], min(x for x in v.scores if x > lattice.NEVER) - 10)


def test_sharpness():
    scores = -np.arange(50.0)
    for x in (0.01, 0.3, 1.0, 5.0):
        assert np.isclose(lattice.sharpness_of(scores, (np.exp(lattice.log_weights(scores, x)) * scores).sum()), x, rtol=1e-6)


def test_lattice_scores(docs, none):
    got = lattice.score(docs, block_bytes=2000).collect()
    rows = corpus()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts, n = {}, 0
    for r in rows:
        if not held(r[0]):
            for w in [*(r[1] or "").encode().lower().split(), None]:
                counts[w], n = counts.get(w, 0) + 1, n + 1
    norm = math.log10(n + 0.1 * (len(counts) + 1))
    want = []
    for r in rows:
        t = [*(r[1] or "").encode().lower().split(), None]
        want.append((r[0], held(r[0]), len(t), sum(counts.get(w, 0) > 0 for w in t), n, round(sum(math.log10(counts.get(w, 0) + 0.1) - norm for w in t), 4)))
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got], key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lattice.score(none).count() == 0
    few = docs.filter("doc_id < 40 or doc_id is null")
    longest = max(map(len, lattice.pieces()[0]))
    for sharp, zipf in ((1.0, True), (1.0, False), (None, True)):
        piece = dict(zip(*lattice.pieces(zipf=zipf), strict=True))
        got = lattice.score(few, sharpness=sharp, zipf=zipf).collect()
        train = [w for r in corpus() if (r[0] is None or r[0] < 40) and not held(r[0]) for w in (r[1] or "").encode().lower().split()]
        n = sum(1 for r in corpus() if r[0] is not None and r[0] < 40 and not held(r[0]))

        def sums(word, x, z):
            """log of the sum of all segmentations' weights, expected pieces and sum of scores, in plain arithmetic of logarithms"""
            a = [(0.0, 0.0, 0.0)]
            for j in range(1, len(word) + 1):
                terms = [(a[i][0] + x * piece[word[i:j]] - z, a[i][1] + 1, a[i][2] + piece[word[i:j]]) for i in range(max(0, j - longest), j) if word[i:j] in piece]
                top = max(t[0] for t in terms)
                w = [math.exp(t[0] - top) for t in terms]
                a.append((top + math.log(sum(w)), sum(u * t[1] for u, t in zip(w, terms, strict=True)) / sum(w), sum(u * t[2] for u, t in zip(w, terms, strict=True)) / sum(w)))
            return a[-1]

        x = sharp or 1.0
        for _ in range(1 if sharp else 3):
            z = math.log(sum(math.exp(x * v) for v in piece.values()))
            of = {w: sums(b" " + w, x, z) for w in set(train)}
            k, t = sum(of[w][1] for w in train), sum(of[w][2] for w in train)
            if not sharp:
                x = lattice.sharpness_of(np.array(list(piece.values())), t / k)
        z, end = math.log(sum(math.exp(x * v) for v in piece.values())), n / (n + k)
        text = {r[0]: r[1] for r in corpus() if r[0] is not None and r[0] < 40}
        for r in got:
            if r["doc_id"] is not None:
                want = math.log(end) + sum(sums(b" " + w, x, z - math.log(1 - end))[0] for w in (text[r["doc_id"]] or "").encode().lower().split())
                assert math.isclose(r["score"], want / math.log(10), rel_tol=1e-6), (sharp, r["doc_id"])


def test_lattice_learns_weights_and_words(docs):
    surfaces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab", b"bc", b"abc"]
    first, at = np.array([s.startswith(b" ") for s in surfaces]), {s: i for i, s in enumerate(surfaces)}
    logp = lattice.split_weights(np.random.default_rng(1).dirichlet(np.ones(len(surfaces))), first, 0.3)
    assert np.isclose(np.exp(logp[first]).sum(), 1) and np.isclose(np.exp(logp[~first]).sum(), 0.7)

    def ways(w):
        return [[at[w[:k]], *r] for k in range(1, len(w) + 1) if w[:k] in at for r in ways(w[k:])] if w else [[]]

    ws, want = [b" abc", b" a", b" aab", b" abcabc"], np.zeros(len(surfaces))
    for w in ws:
        p = np.array([math.exp(logp[x].sum()) for x in ways(w)])
        for q, x in zip(p / p.sum(), ways(w), strict=True):
            np.add.at(want, x, q)
    assert np.allclose(lattice.uses(lattice.Lattice(surfaces), ws, logp), want)
    got = lattice.score(docs, learn=True).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    mean = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert mean("score") > mean("base_score") - 1
    old = [r for r in lattice.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in old) < sum(r["score"] for r in held)


def test_warc(spark):
    rows = [(3, "http://a/ b\n", "<p>x</p>" * 50), (1, None, "<p>x</p>" * 50), (2, "u", None), (5, "u", ""), (1, "dup", "<p>x</p>" * 50), (7, "u", "é" * 100), (None, "u", "<p>x</p>" * 50)] + [(100 + i, f"http://h/{i}", f"<html>{i} " + "shared words " * 40) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).checkpoint()
    df = df.withColumns({"payload": F.lit(7), "record_type": F.lit("clash"), "least": F.lit(1), "uid": F.lit(0), "key": F.lit("k")})
    for per in (32 << 20, 3000):
        path = Scratch(spark, "t").path("w")
        warc.write(df, path, archive_bytes=per)
        assert (spark.read.format("binaryFile").load(path).count() > 4) == (per == 3000)
        got = warc.read(spark, path).collect()
        assert len(got) == len(rows)
        assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((len(b), warc.b32(hashlib.sha1(b).digest())) for b in ((r[2] or "").encode() for r in rows))
        same = [r for r in got if r["payload_bytes"] == 400]
        assert sorted(r["record_type"] for r in same) == ["response"] + ["revisit"] * 3
        first = next(r for r in same if r["record_type"] == "response")
        assert first["page_id"] == "1"
        assert {r["refers_to_id"] for r in same if r["record_type"] == "revisit"} == {first["record_id"]}
        assert sorted((r["record_type"], r["page_id"]) for r in got if not r["payload_bytes"]) == [("response", "2"), ("revisit", "5")]
    assert min(r["record_type"] for r in warc.read(spark, path).collect()) == "response"
    path = Scratch(spark, "t").path("w")
    warc.write(df, path, min_bytes=1)
    assert {r["record_type"] for r in warc.read(spark, path).collect() if not r["payload_bytes"]} == {"response"}
    path = Scratch(spark, "t").path("w")
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_warc_frames_stand_alone():
    import struct

    import zstandard

    records = [warc.record("response", f"urn:{i}", i, "u", b"shared content " * 30 + str(i).encode(), "D", None, "d") for i in range(200)]
    whole = list(warc.archives([(r, True) for r in records], 4096, 1 << 20, 1 << 20, 3))
    assert len(whole) == 1
    assert len(list(warc.archives([(r, True) for r in records], 4096, 1 << 20, 1, 3))) == 200
    first, *rest = whole[0].split(warc.EMPTY_FRAME.encode())
    assert first[:4] == warc.DICT_MAGIC
    raw = first[8:]
    assert struct.unpack("<I", first[4:8])[0] == len(raw) > 0
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert [d.decompress(f) for f in rest] == records


def test_warc_long_pages(spark):
    long = [(i, "u", "".join(chr(97 + (i * j * j) % 26) for j in range(300_000))) for i in range(1, 6)]
    path = Scratch(spark, "t").path("w")
    warc.write(spark.createDataFrame(long, "page_id long, url string, html string").coalesce(1), path, archive_bytes=700_000)
    assert sorted(r["payload"].decode() for r in warc.read(spark, path).collect()) == sorted(x[2] for x in long)
    assert spark.read.format("binaryFile").load(path).filter("length > 0").count() == 3


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<h1>T</h1>x  y\n z", "T\n\nx y z"),
        ("<p>a<script>var x='</p>'</script>b<style>p{}</style>", "ab"), ("<p hidden>a</p><p style='display: none'>b</p><p>c", "c"), ("<!-- x <p> -->a", "a"), ("a &lt;b&gt; &amp; &nbsp;c", "a <b> & c"),
        ("<table><tr><td>a<td>bbb<tr><th>cc<td>d</table>", "a  | bbb\ncc | d"), ("<table><tr><td colspan=2>wide cell<tr><td>x<td>y</table>", "wide cell\nx | y"), ("<pre>a\n  b\n</pre>c", "a\n  b\n\nc"), ("<td>loose", "loose"),
        ("<details><summary>s</summary>h</details>z", "s\nz"), ("x</p>y", "x\n\ny"), ("<a href='>'>t</a>", "t"), ("1 < 2 <", "1 < 2 <"), ("", ""), ("<title>T</title>b", "b"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<b>a</b> <i>b</i>", "a b"),
    ],
)
def test_html(source, want):
    assert html_layout.render(source)[1] == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<head><title>T</title><p>Hello", ("T", "Hello")), ("<html><head><meta charset=utf-8>\n<link rel=x><script>s()</script><style>p{}</style><div>a</div>b", ("", "a\nb")), ("<head><title>T</title> text <b>b</b>", ("T", "text b")),
        ("<head>&#32;<title>T</title>&nbsp;x", ("T", "x")), ("<head><template><p>no</p>no</template><noscript><p>no</noscript><p>yes", ("", "yes")), ("<head><title>T</title></head><body><p>x", ("T", "x")), ("<head><title>T</title><body><p>x", ("T", "x")),
    ],
)
def test_html_ends_an_open_head(source, want):
    assert html_layout.render(source) == want


def test_html_raw_text_ends_in_any_case():
    assert html_layout.render("İ<SCRIPT>x</SCRIPT>a<STYLE>p{}</Style>b<TITLE>İ T</TiTle>c") == ("İ T", "İabc")
    assert html_layout.render("<script>x</\u017fcript>y</script>a")[1] == "a"


def test_html_wide_tables():
    wide = "w" * 500
    assert html_layout.render(f"<table><tr><td>{wide}<td>a<tr><td>b<td>c</table>")[1] == f"{wide} | a\nb{' ' * 499} | c"
    cells = lambda n, x: "".join(f"<td>{x}" for _ in range(n))
    got = html_layout.render(f"<table><tr><td colspan=150>s<td>e<tr>{cells(150, 'x')}<td>last</table>")[1].split("\n")
    assert got == ["s".ljust(597) + " | e", " | ".join(["x"] * 150 + ["last"])]
    ragged = html_layout.render(f"<table><tr><td>{'w' * 40_000}<td>a" + "<tr><td>b<td>c" * 40_000 + "</table>")[1]
    assert ragged == "w" * 40_000 + " | a" + "\nb | c" * 40_000


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A | b\n  | c"), ("<table><tr><td colspan=2>wide cell<td>q<tr><td>x<td>y<td>z</table>", "wide cell | q\nx | y     | z"), ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>", "A | b\n  | c\n  | d"),
        ("<p style='visibility:hidden'>a<b style='visibility:visible'>c</b></p>", "c"), ("<p style='display:none'>a<b style='display:block'>c</b></p>", ""), ("<p hidden style='display:block'>a", "a"), ("<p style='visibility:hidden;visibility:visible'>a", "a"),
        ("<svg><title>t</title><text>hi</text></svg> <math><mi>x</mi><annotation>no</annotation></math>", "hi x"), ("<textarea>\na &lt;b\nc</textarea>d", "a <b\ncd"), ("<form>Name <input value=Bob> <input type=hidden value=no><input type=submit value=Go></form>", "Name Bob Go"),
        ("<select><option>a<option selected>b</select>z", "b z"), ("<select><option>a<option>b</select>", "a"), ("<select multiple><option>a<optgroup><option>b</select>z", "a\nb\nz"), ("<datalist><option>a</datalist>b", "b"),
        ("<ol><li value=5>x<li>y</ol>", "5. x\n6. y"), ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"), ("<ol type=i start=4><li>x<li>y</ol>", "iv. x\nv. y"), ("<ol type=A start=27><li>x</ol>", "AA. x"), ("a<plaintext><p>b</p>", "a\n\n<p>b</p>"),
        ("<ul><li><ul><li>x<li>y</ul><li></ul>z", "- - x\n  - y\n\nz"), ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"), ("<pre>a\n<ul><li>x</ul>b</pre>", "a\n- x\nb"), ("<ul><li>a<table><tr><td>x<td>y</table>b</ul>", "- a\n\n  x | y\n\n  b"),
    ],
)
def test_html_layout(source, want):
    assert html_layout.render(source)[1] == want


@pytest.mark.parametrize("unit", ["<li>", "<ul><li>", "<ul><li>x", "<div>", "<p><b>", "<blockquote>x", "<pre>x", "<td rowspan=60000>x", "<select><option>x", "<p><table><td><span>"])
def test_html_of_deep_pages_takes_linear_time(unit):
    began = time.process_time()
    got = html_layout.render(unit * 20_000)[1]
    assert time.process_time() - began < 5
    assert got.count("x") == 20_000 * unit.count("x")


def test_html_long_attributes():
    long = "<script>1 > 0 " * 8000
    for q in "'\"":
        assert html_layout.render(f"a<p data-x={q}{long}{q} hidden>b</p><p>c") == ("", "a\n\nc")
        assert html_layout.render(f"<table><tr><td data-x = {q}{long}{q} colspan=2>wide cell<tr><td>x<td>y</table>")[1] == "wide cell\nx | y"
    assert html_layout.render("<p title=it's>a</p>" + "b " * 5000 + "<p title=it's>c</p>")[1] == "a\n\n" + "b " * 4999 + "b\n\nc"
    assert html_layout.render("<a href=x?y=\">t</a>")[1] == "t"
    assert html_layout.render("<p hidden id='x>a</p><p>b")[1] == "b"
    assert html_layout.render("x <b y </i z")[1] == "x <b y"


@pytest.mark.parametrize("unit", ["<b a=\">\" ", "<b a=\">\" c='>' ", "<b a='", "<b a=\">", "<b ", "<b", "<b a=\"'>"])
def test_html_takes_linear_time(unit):
    began = time.process_time()
    html_layout.render(unit * 60_000)
    assert time.process_time() - began < 10


def test_minhash_finds_short_pairs_that_share_no_band(spark):
    m, rng, lost = minhash.MinMax(56, 6, 5), random.Random(3), []
    while len(lost) < 2:
        w = [rng.randbytes(4).hex().encode() for _ in range(8)]
        keys = [set(m.keys(m.signature(minhash.shingles(x, 5, minhash.Hashes()))).tolist()) for x in (w[:7], w)]
        if not keys[0] & keys[1]:
            lost.append(w)
    rows = [(10 * i + j, b" ".join(x).decode()) for i, w in enumerate(lost) for j, x in enumerate((w[:7], w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(minhash.near_groups(df), "doc_id", "component_id") == [(0, 0), (1, 0), (10, 10), (11, 10)]


def test_minhash_prefixes_and_tiles():
    rng = np.random.default_rng(4)
    for n in range(1, 22):
        s = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for k in range(-(-3 * n // 4), n):  # subsets that link
            t = np.sort(rng.choice(s, k, replace=False))
            assert set(minhash.prefix_keys(s, 75).tolist()) & set(minhash.prefix_keys(t, 75).tolist())
    assert len(minhash.prefix_keys(np.arange(22, dtype=np.uint64), 75)) == 0
    sets = [np.unique(rng.integers(0, 400, n, np.uint64)) for n in rng.integers(1, 300, 40)]
    want = [[len(np.intersect1d(s, t)) for t in sets[25:]] for s in sets[:25]]
    for columns in (7, 4096):
        assert minhash.overlaps(sets[:25], sets[25:], columns).tolist() == want
    side = lambda v, *s: (np.array(v), np.array([len(x) for x in s]), np.array(v), list(s))
    a, b = np.arange(15, dtype=np.uint64), np.arange(20, dtype=np.uint64)
    assert list(minhash.tile(side([1], a), side([2], b), False, 75)) == [(1, 2)]
    assert list(minhash.tile(side([1], a[1:]), side([2], b), False, 75)) == []
    assert list(minhash.tile(side([1, 2, 3], a, b, b), side([1, 2, 3], a, b, b), True, 75)) == [(1, 2), (1, 3)]


def test_html_is_robust(spark):
    assert html_layout.render("<div>" * 20000 + "x" + "</div>" * 20000)[1] == "x"
    assert html_layout.render("<a \"" * 3000 + "x")[1] is not None
    assert html_layout.render(None) == ("", "")
    df = spark.createDataFrame([(1, None, "t"), (2, "<title>A &amp; b</title><p>x", "t")], "page_id long, html string, title string")
    assert tuples(html_layout.extract(df), "page_id", "title", "text") == [(1, "", ""), (2, "A & b", "x")]
    long = "<ul>" + "<li>item " * 100_000
    again = df.unionByName(df).unionByName(spark.createDataFrame([(3, long, "t")], df.schema)).withColumns({"text": F.lit("clash"), "r": F.lit(1), "row": F.lit("x")})
    got = html_layout.extract(again)
    assert got.columns == ["page_id", "r", "row", "title", "text"]
    assert sorted((r["page_id"], len(r["text"]), r["row"]) for r in got.collect()) == [(1, 0, "x"), (1, 0, "x"), (2, 1, "x"), (2, 1, "x"), (3, 100_000 * 7 - 1, "x")]
    assert html_layout.extract(df.limit(0)).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(700):
        bad = i % 4 == 0
        w = words(rng, 40).split()
        if bad:
            for k in rng.sample(range(40), 2):
                w[k] = rng.choice(["idiot,", "MORON", "scum."])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(None, None), (900, ""), (901, "idiot " * 5000)]
    marks += [(None, 1), (5, None), (8, 0), (8, 1)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = toxicity.score(df, model).collect()
    truth = dict(marks)
    test = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] is not None]
    assert len(test) > 80
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert next(r for r in got if r["doc_id"] == 901)["predicted"] == 1
    assert len(got) == len(rows)
    assert len(model[0]) < 2000
    twice = toxicity.score(df.unionByName(df).withColumns({"score": F.lit("clash"), "s": F.lit(1)}), model).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("score").alias("scores")).filter("doc_id is not null").collect()
    assert {(r["n"], r["scores"]) for r in twice} == {(2, 1)}
    assert toxicity.score(none.select("doc_id", "text"), model).count() == 0
    empty = toxicity.train(df, lab.limit(0))
    assert {r["predicted"] for r in toxicity.score(df, empty).collect()} == {0}


def test_ftrl_against_plain_python(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "Ee!"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    marks = [(i, int("bb" in t and "cc" in t)) for i, t in rows]
    df, lab = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, toxic string, score double"), spark.createDataFrame(marks, "doc_id long, toxic int")
    hashes = minhash.Hashes()

    def features(t):
        return sorted(set(toxicity.places(t.encode(), hashes).tolist())) + [1 << toxicity.BITS]

    train = [(t, y) for (i, t), (_, y) in zip(rows, marks, strict=True) if zlib.crc32(str(i).encode()) % 5]
    order = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    train = sorted(((order[i], t, y) for (i, t), (_, y) in zip(rows, marks, strict=True) if zlib.crc32(str(i).encode()) % 5))
    z, n = {}, {}

    def weight(f):
        x, l1 = z.get(f, 0.0), 0.0 if f == 1 << toxicity.BITS else 8.0
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((1.0 + math.sqrt(n.get(f, 0.0))) / 2.0)

    for _ in range(6):
        for _, t, y in train:
            fs = features(t)
            w = {f: weight(f) for f in fs}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in fs:
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / 2.0 * w[f]
                n[f] = n.get(f, 0.0) + g * g
    got = toxicity.score(df, toxicity.train(df, lab), payload=df.columns, as_row=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["score"], 1 / (1 + math.exp(-sum(weight(f) for f in features(r["row"]["text"])))), rel_tol=1e-6)
        assert r["row"]["score"] == 0.5
    bounded = toxicity.train(df, lab, sample_bytes=1)  # the first example of each class
    assert all(np.isfinite(bounded[1]))


CLASH = ["predicted", "score", "held_out", "kept", "keep_id", "group_size", "text_sha256", "n_shingles", "component_id", "members", "size", "copies", "taken", "copy", "row", "id", "t", "h", "h1", "uid", "n", "fp", "key", "ids", "n_pieces", "mk"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    text = [None, "", " \t", "one", *(words(rng, 40) for _ in range(12)), words(rng, 40_000)]
    rows = [(i if i % 7 else None, t, None if i % 5 else "en", [None, "s0", "s1"][i % 3], i, *(7 for _ in CLASH)) for i, t in enumerate(text * 2)]
    rows += rows[:6]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASH)
    spark.createDataFrame([(i, 1, int(i % 3 == 0), "clash") for i in range(30)], "doc_id long, quality int, toxic int, text string").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = Scratch(spark, "t").table(stage(spark, docs, str(tmp_path)), f"s{k}")
            if k < 4:
                assert docs.columns == before.columns
                assert docs.exceptAll(before.withColumn("copy3", F.explode(F.array(*map(F.lit, range(3))))).drop("copy3")).count() == 0
            assert all(r[0] == 7 for r in docs.select("predicted", "copy", "size").distinct().collect())
        assert set(docs.columns) == set(before.columns)
        if rows and before.count():
            v = vocabulary.load()
            for r in docs.collect():
                assert (r["ids"] is None) == (r["text"] is None)
                assert r["n_pieces"] == len(r["ids"] or [])
                assert pieces.decode_ids(np.array(r["ids"] or [], np.int32), v.surface) == (r["text"] or "")


def plain_mix(rows, weights=(5, 2, 1), limit=3):
    """Copies of each of rows (source, words, hash); no two share a hash, and there are fewer of a source than mixing.WINDOW."""
    names = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for of, n, _ in rows if of == s) for s in names}
    wanted, open_ = {}, dict(zip(names, weights * len(names), strict=False))
    while over := [s for s in open_ if (sum(size.values()) - sum(wanted.values())) * open_[s] / sum(open_.values()) > limit * size[s]]:
        wanted |= {s: limit * size[s] for s in over}
        open_ = {s: w for s, w in open_.items() if s not in over}
    left, total = sum(size.values()) - sum(wanted.values()), sum(open_.values())
    wanted |= {s: left * w / total for s, w in open_.items()}
    copies = {}
    for s in names:
        whole, rest = divmod(round(wanted[s]), size[s])
        own = sorted((h, n) for of, n, h in rows if of == s)
        ends = [(abs(rest - sum(n for _, n in own[:k])), k) for k in range(len(own) + 1)]
        taken = {h for h, _ in own[: min(ends)[1]]}
        at = max(k for k in range(len(own) + 1) if sum(n for _, n in own[:k]) <= rest)
        for behind in (own[at:], sorted(own[at:], key=lambda x: (-x[1], x[0]))):
            gap, more = rest - sum(n for _, n in own[:at]), set()
            for h, n in behind:
                if n <= gap and len(more) < mixing.PICKS:
                    gap, more = gap - n, more | {h}
            if gap < abs(rest - sum(n for h, n in own if h in taken)):
                taken = {h for h, _ in own[:at]} | more
        copies |= {h: whole + (h in taken) for h, _ in own}
    return copies


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    base = [(i, words(rng, 50), "en", f"s{i % 2}", 0) for i in range(60)]
    bad = [(100 + i, words(rng, 50) + " idiot moron", "en", "s0", 0) for i in range(30)]
    copies = [(200 + i, base[i][1] + " ", "en", "s1", 0) for i in range(5)]
    near = [(300 + i, base[i][1] + " more", "en", "s1", 0) for i in range(5)]
    rows = base + bad + copies + near
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(100 <= r[0] < 200)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "t").table(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs.toPandas())
    assert set(seen[0].doc_id) == {r[0] for r in rows if not 100 <= r[0] < 200}
    assert len(seen[1]) == 65
    assert len(seen[2]) == 60
    # every stage against plain Python on what the one before it kept
    clean = [r for r in rows if not 100 <= r[0] < 200]
    groups = {}
    for r in clean:
        groups.setdefault(plain(r[1]), []).append((-len(r[1]), r[0], r))
    alone = sorted(min(g)[2] for g in groups.values())
    assert sorted(seen[1].itertuples(index=False, name=None)) == alone
    firsts = sorted(r for r, (i, _, c) in zip(sorted(alone, key=lambda r: str((r[0],))), sorted(near_brute(alone), key=lambda x: str((x[0],))), strict=True) if i == c)
    assert sorted(seen[2].itertuples(index=False, name=None)) == firsts
    ids = spark.createDataFrame([(r[0],) for r in firsts], "doc_id long")
    h = {r.doc_id: r.h for r in ids.select("doc_id", F.xxhash64(F.lit(17), "doc_id").bitwiseAND((1 << 63) - 1).alias("h")).collect()}
    copies = plain_mix([(r[3], len(r[1].split()), h[r[0]]) for r in firsts])
    mixed = sorted(r for r in firsts for _ in range(copies[h[r[0]]]))
    assert sorted(seen[3].itertuples(index=False, name=None)) == mixed
    v = vocabulary.load()
    coded = {t: [i for w in pieces.marked(t) for i in segment_brute(w, v)] for t in {r[1] for r in mixed}}
    want = sorted((*r, coded[r[1]]) for r in mixed)
    assert sorted((*r[:5], list(r.ids)) for r in seen[4].itertuples(index=False)) == want
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, list(r.ids), r.n_pieces) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [(*r, len(r[-1])) for r in want]
    for r in seen[4].itertuples():
        assert pieces.decode_ids(np.array(r.ids), v.surface) == r.text
    shutil.rmtree(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
