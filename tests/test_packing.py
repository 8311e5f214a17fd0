"""Packing cut into parts against the plain fold of a whole repository."""

import random

import pandas as pd
import pytest

from factloom.operators import scoring

KIND = "repo string, path string, rank long, score int, changed boolean, full long, summary_chars long, parsed boolean, sections array<struct<tokens:bigint,chars:bigint>>"


def repository(r, name, n):
    out = []
    for rank in range(1, n + 1):
        full = r.choice([None, 0, 0, 1, 3, 40, 200, 900, 8001, 30000])
        parts = [(t, 4 * t + r.randint(0, 40)) for t in (r.choice([1, 50, 700, 4000]) for _ in range(r.randint(0, 4)))]
        out.append((name, f"f{rank}", rank, r.choice([0, 29, 30, 80]), r.random() < 0.2, full, r.choice([4, 60, 400, 3000]), r.random() < 0.6, [{"tokens": t, "chars": c} for t, c in parts]))
    return out


@pytest.mark.parametrize(("budget", "compress"), [(0, False), (900, False), (20_000, False), (60_000, True), (150_000, False), (10**9, False), (300, True)])
def test_parts_agree_with_fold(spark, budget, compress):
    r = random.Random(budget)
    rows = [x for name, n in (("a", 90), ("b", 1), (None, 40), ("c", 7)) for x in repository(r, name, n)]
    rows += [("tiny", f"t{i}", i, 0, False, 1, 800, False, []) for i in range(1, 200)]
    r.shuffle(rows)
    got = scoring.pack(spark.createDataFrame(rows, KIND).repartition(5), budget, ("repo",), compress, part_rows=7, ahead=2).collect()
    assert len(got) == len(rows)
    for name in ("a", "b", None, "c", "tiny"):
        own = sorted((x for x in rows if x[0] == name), key=lambda x: x[2])
        frame = pd.DataFrame([x[1:] for x in own], columns=["path", "rank", "score", "changed", "full", "summary_chars", "parsed", "sections"])
        want = scoring.pack_plan(frame, budget, compress).itertuples(index=False)
        mine = sorted(((x.path, x.tier, x.tokens, x.rank, x.shape, list(x.taken)) for x in got if x.repo == name), key=lambda x: x[3])
        assert mine == [(w.path, w.tier, w.tokens, w.rank, w.shape, list(w.taken)) for w in want]


def test_one_repository_without_a_name(spark):
    rows = [x[1:] for x in repository(random.Random(1), "a", 60)]
    frame = spark.createDataFrame(rows, KIND.partition(", ")[2])
    assert scoring.pack(frame, 5000, part_rows=10).filter("tier != 'skip'").count() == scoring.pack(frame, 5000).filter("tier != 'skip'").count() > 0
    assert scoring.pack(frame.limit(0), 5000).count() == 0
