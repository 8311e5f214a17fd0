"""Pruned search finds what the full search finds, and compares less where vectors are clustered."""

import numpy as np
import pytest

from factloom.operators import pruned, retrieval


@pytest.mark.parametrize(("clusters", "pivots"), [(1, 8), (25, 40), (25, 1)])
def test_same_as_full_search(spark, clusters, pivots):
    r = np.random.default_rng(clusters)
    centres = r.normal(size=(clusters, 6)) * 10
    x = centres[r.integers(0, clusters, 700)] + r.normal(size=(700, 6)) * 0.3
    x[100:160] = x[100]  # a group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (801, [1.0] * 5), (802, [float("nan")] * 6), (803, [None] * 6), (804, [float("inf")] * 6)]
    chunks = spark.createDataFrame([(*v, "clash") for v in rows], "id int, embedding array<double>, cell string")
    asked = [(f"q{i}", (x[i * 9] + 0.01 * i).tolist()) for i in range(40)] + [("same", x[100].tolist()), ("none", None), ("odd", [0.0] * 4)]
    got, stats = pruned.knn_pruned(chunks, spark.createDataFrame(asked, "q string, vector array<double>"), 70, 6, "q", "id", pivots)
    want = []
    for name, y in asked:
        if y is not None and len(y) == 6:
            d = np.zeros(len(x))
            for j in range(6):
                d += (np.array(y)[j] - x[:, j]) ** 2
            d = np.sqrt(d)
            want += [(name, int(i), d[i], n + 1) for n, i in enumerate(np.lexsort((np.arange(len(x)), d))[:70])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    s = stats.first()
    assert s.pairs == 41 * 700
    if clusters > 1 and pivots > 1:
        assert s.compared < 0.4 * s.pairs
    none, _ = pruned.knn_pruned(chunks.limit(0), spark.createDataFrame(asked, "q string, vector array<double>"), 3, 6, "q", "id")
    assert none.count() == 0
    few, _ = pruned.knn_pruned(chunks.filter("id < 3"), spark.createDataFrame(asked[:2], "q string, vector array<double>"), 5, 6, "q", "id")
    assert few.count() == 6


def test_nearest_is_exact_with_ties_and_odd_numbers():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 5)), 1)
    x[50:90] = x[50]
    y = np.vstack([x[:40] + 1e-9, x[50:52], r.normal(size=(20, 5))])
    for scale, odd in ((1.0, False), (1e-170, False), (1e120, False), (1e200, False), (1.0, True)):
        for k in (1, 7, 60, 500):
            a, b, bad = x * scale, y * scale, np.zeros(len(x), bool)
            if odd:
                a, bad[5:20], bad[270:] = a.copy(), True, True
                a[0], a[1], b[3] = np.nan, np.inf, np.nan
            d = np.zeros((len(b), len(a)))
            with np.errstate(all="ignore"):
                for j in range(5):
                    d += (b[:, j, None] - a[None, :, j]) ** 2
                d = np.sqrt(d)
                d[:, bad] = np.nan
                got = [np.concatenate(f) for f in zip(*retrieval.nearest(a, b, bad, k, 16), strict=True)]
            want = [np.lexsort((np.arange(len(a)), v, bad))[:k] for v in d]
            assert got[0].tolist() == np.repeat(np.arange(len(b)), min(k, len(a))).tolist()
            assert got[1].tolist() == np.concatenate(want).tolist()
            assert np.array_equal(got[2], np.concatenate([v[w] for v, w in zip(d, want, strict=True)]), equal_nan=True)


def test_tiles_of_a_search_are_tasks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", (10, 50))
    x = np.random.default_rng(4).normal(size=(200, 3))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    q = e.filter("id < 30").selectExpr("id as q", "embedding as vector")
    near = retrieval.knn_batch(e, q, 4, "q", "id")
    assert "REPARTITION_BY_NUM, " in near._jdf.queryExecution().executedPlan().toString() and ", 24)" in near._jdf.queryExecution().executedPlan().toString()
    d = np.sqrt(((x[:30, None] - x[None]) ** 2).sum(2))
    assert sorted((r.q, r.id, r["rank"]) for r in near.collect()) == sorted((i, int(j), n + 1) for i in range(30) for n, j in enumerate(np.argsort(d[i], kind="stable")[:4]))


def test_pruned_search_broadcasts_no_vectors(spark, monkeypatch):
    plans, table = {}, pruned.Work.table

    def spy(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return table(self, df, name)

    monkeypatch.setattr(pruned.Work, "table", spy)
    e = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(60)], "id int, embedding array<double>")
    pruned.knn_pruned(e, e.filter("id < 9").selectExpr("id as q", "embedding as vector"), 3, 2, "q", "id", 5)[0].collect()
    assert all("BroadcastHashJoin" not in plans[n] for n in ("first", "others", "second"))
