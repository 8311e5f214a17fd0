"""Streams with keyed state, restarted from their checkpoints, against the twins over finished logs."""

import datetime
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.streaming import stateful as S

DAY = datetime.datetime(2024, 1, 1)


def feed(spark, root, schema):
    return lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)


@pytest.fixture
def places(tmp_path):
    return [f"{tmp_path}/{x}" for x in ("in", "out", "check")]


def test_jobs(spark, places):
    schema, r = "job_id long, seq long, state string", random.Random(3)
    log = [(j, s, r.choice(["queued", "running", "completed", "failed"])) for j in range(12) for s in range(14)]
    log += [(50, 0, "running"), (50, 1, "queued"), (50, 2, "completed"), (50, 3, "running"), (50, 4, "failed"), (50, 5, "queued")]
    put = feed(spark, places[0], schema)
    for lo, hi in ((0, 3), (3, 4), (4, 14)):
        put([x for x in log if lo <= x[1] < hi])
        S.run_once(S.job_log(spark.readStream.schema(schema).parquet(places[0])), *places[1:], ok="ok")
    rows, refused = (spark.read.parquet(f"{places[1]}/{x}").drop("batch") for x in ("rows", "refused"))
    assert refused.filter("ok").count() == rows.filter("not ok").count() == 0 < refused.count()
    whole = sorted(map(tuple, rows.unionByName(refused).collect()))
    assert whole == sorted(map(tuple, S.job_moves(spark.createDataFrame(log, schema)).collect()))
    now, want = {}, []
    for j, s, to in sorted(log):
        was = now.get(j)
        ok = (was, to) in {(None, "queued"), ("queued", "running"), ("running", "completed"), ("running", "failed")}
        want.append((j, s, to, was, ok))
        now[j] = to if ok else was
    assert whole == sorted(want)


def test_sessions_expire(spark, places):
    schema = "session_id long, sequence long, kind string, at timestamp"
    at = lambda h: DAY + datetime.timedelta(hours=h)
    put = feed(spark, places[0], schema)
    turns = [
        [(1, 1, "token", at(0)), (1, 2, "token", at(0)), (2, 2, "token", at(0))],  # 2 begins with a gap
        [(1, 3, "final", at(1)), (2, 1, "final", at(1)), (2, 2, "error", at(1))],  # after a restart 1 goes on; 2 cannot end twice
        [(3, 1, "token", at(20)), (2, 2, "token", at(20))],  # 2 is open again, before its day is over
        [(3, 2, "token", at(60))],
        [(3, 3, "token", at(61)), (1, 1, "token", at(61)), (2, 3, "token", at(61))],  # 1 was forgotten and begins anew
    ]
    for t in turns:
        put(t)
        S.run_once(S.session_log(spark.readStream.schema(schema).parquet(places[0])), *places[1:], ok="ok")
    got = spark.read.parquet(f"{places[1]}/rows").drop("batch")
    refused = sorted(map(tuple, spark.read.parquet(f"{places[1]}/refused").select("session_id", "sequence", "kind").collect()))
    assert refused == [(2, 2, "error"), (2, 2, "token")]
    assert [r.session_id for r in got.filter("kind = 'expired'").collect()] == [1]
    assert sorted(map(tuple, got.filter("session_id = 1 and kind != 'expired'").select("sequence", "kind").collect())) == [(1, "token"), (1, "token"), (2, "token"), (3, "final")]
    assert sorted(r.sequence for r in got.filter("session_id = 2").collect()) == [1, 2, 3]


def test_requests_join_jobs(spark, places):
    schema, r = "target string, seq long, request string, state string", random.Random(5)
    log = [(r.choice(["a", "A ", "b", "c"]), s, None, r.choice(["completed", "failed", "running"])) if r.random() < 0.3 else (r.choice(["a", "b", " b"]), s, f"r{s}", None) for s in range(90)]
    put = feed(spark, places[0], schema)
    for lo, hi in ((0, 10), (10, 11), (11, 50), (50, 90)):
        put(log[lo:hi])
        S.run_once(S.in_flight(spark.readStream.schema(schema).parquet(places[0])), *places[1:])
    got = spark.read.parquet(f"{places[1]}/rows").drop("batch")
    twin = S.in_flight_jobs(spark.createDataFrame(log, schema))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, twin.collect()), key=str)
    assert got.filter("joined").count() > 10 and got.filter("served > 1").count() > 3
    assert got.groupBy("job").agg(F.countDistinct("target").alias("n")).filter("n > 1").count() == 0


def counted(base, calls):
    class Counted(base):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            tempfile.mkstemp(dir=calls)
            yield from base.handleInputRows(self, key, rows, timerValues)

    return Counted


@pytest.mark.parametrize("jobs", [True, False])
def test_many_keys_take_few_calls(spark, places, tmp_path, monkeypatch, jobs):
    calls, r = tmp_path / "calls", random.Random(7)
    calls.mkdir()
    name = "Jobs" if jobs else "InFlight"
    monkeypatch.setattr(S, "BUCKETS", 8, raising=False)
    monkeypatch.setattr(S, name, counted(getattr(S, name), str(calls)))
    keys = [None, -(2**62), *range(2**60, 2**60 + 298)]
    log = [(k, s, r.choice(["queued", "running", "completed", "failed"])) for s in range(6) for k in keys]
    if jobs:
        schema, stream, twin = "job_id long, seq long, state string", S.job_log, S.job_moves
    else:
        schema, stream, twin = "target string, seq long, request string, state string", S.in_flight, S.in_flight_jobs
        log = [(k and f"t{k}", s, None if state == "failed" else f"r{k}-{s}", state if state == "failed" else None) for k, s, state in log]
    put = feed(spark, places[0], schema)
    for lo, hi in ((0, 4), (4, 5), (5, 6)):
        put([x for x in log if lo <= x[1] < hi])
        S.run_once(stream(spark.readStream.schema(schema).parquet(places[0])), *places[1:])
    got = spark.read.parquet(f"{places[1]}/rows").drop("batch")
    want = twin(spark.createDataFrame(log, schema))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len(list(Path(calls).iterdir())) <= 3 * 8  # three batches; a call for each key before
