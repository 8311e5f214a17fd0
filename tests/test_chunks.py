"""Chunks as expressions against plain Python: headers, boundaries, surrogates, blank and long texts."""

import random

import plain_chunks
import pytest

from factloom.operators import chunks

PARTS = ["# One", "## Two ", "###　Three", "#### no", "#no", " # no", "# ", "#  \t", "text", "", "  ", "\U0001f600" * 30, "a b", "# \U0001f600 h", "# t\r", "x # y", "﻿", "---", "long " * 700, "w" * 2500, "é\n\n" * 800, "\U0001f600 " * 900, "# Z"]


def texts():
    r = random.Random(9)
    out = ["", " \n　", "---\na: 1\n---\n\n# H\nx", "---\nno end", "x" * 9000, "# A\n" + "  " * 1500 + "y", "# H\n" + "\U0001f600 " * 700, "# H\n\n" + "\U0001f600" * 3000, "\n \n# A\nx", "# A\n" + " " * 3000 + "x" * 10, "# A\n" + ("word " * 40 + "\n\n") * 200, "# End"]
    return out + ["\n".join(r.choice(PARTS) for _ in range(r.randint(1, 9))) for _ in range(150)]


@pytest.mark.parametrize(("size", "overlap"), [(512, 75), (64, 0), (40, 9)])
def test_chunks(spark, size, overlap):
    rows = [(i, "t", "f.md", t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, (len(rows), "t", "f.md", None)], "doc_id int, doc_type string, source_file string, content string")
    got = {}
    for c in chunks.chunk(docs, size, overlap).collect():
        got.setdefault(c.doc_id, []).append((c.chunk_index, c.h1, c.h2, c.h3, c.content, c.content_preview))
    for i, _, _, t in rows:
        want = [(k, c["h1"], c["h2"], c["h3"], c["content"], c["preview"]) for k, c in enumerate(plain_chunks.chunk_text(t, size, overlap))]
        assert sorted(got.get(i, [])) == want, (i, t[:80])
    assert len(rows) not in got
    plan = chunks.chunk(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan
