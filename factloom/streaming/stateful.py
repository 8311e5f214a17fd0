"""Sessions, jobs and requests in flight as keyed state of a stream, each with its twin over the finished log.

State lives in value and map variables of `transformWithState`, in the RocksDB store, and comes back from the checkpoint.
Rows of a key are taken in the order of their sequence within a batch, so what a batch may hold bounds what a task holds:
limit it by maxFilesPerTrigger or maxOffsetsPerTrigger. Jobs and requests in flight are keyed by buckets of their keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from factloom.functions import text as T
from factloom.streaming.sessions import MOVES, TERMINAL, TTL_MS, accepted

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States after which a job is over.
OVER = ("completed", "failed")
#: Buckets of keys; a checkpoint holds for one number only.
BUCKETS = 4096


def use_store(spark: SparkSession) -> None:
    """Sets the session's state store to RocksDB, which keyed state with several variables needs; queries that run keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Keyed(StatefulProcessor):
    """Takes all rows of a key in a batch at once, in order."""

    order = "seq"

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        yield self.take(key[0], pd.concat(list(rows)).sort_values(self.order, kind="stable"), timerValues)

    def close(self) -> None:
        pass


class Dealt(StatefulProcessor):
    """Takes the rows of all keys of a bucket in a batch at once, in order: a call costs more than the rows of a key. `state` has
    a row for each key of which something is known; only keys with rows are read, and those that change written."""

    def init(self, handle) -> None:
        self.state = handle.getMapState("state", "key string", self.kept)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        known = {k: self.state.getValue((k,)) for k in pdf["key"].unique()}
        now = dict(known)
        out = self.take(pdf, now)
        for k, row in now.items():
            if row is None and known[k] is not None:
                self.state.removeKey((k,))
            elif row != known[k]:
                self.state.updateValue((k,), row)
        yield out

    def close(self) -> None:
        pass


def _dealt(rows: DataFrame, key: str, processor: Dealt, schema: str) -> DataFrame:
    """What a processor makes of rows by their key, which may be of any type that strings bring back."""
    use_store(rows.sparkSession)
    own = rows.schema[key].dataType
    keyed = rows.withColumn("key", F.col(key).cast("string")).drop(key).withColumn("bucket", F.pmod(F.hash("key"), F.lit(BUCKETS)))
    out = keyed.groupBy("bucket").transformWithStateInPandas(processor, f"key string, {schema}", "append", "none")
    return out.select(F.col("key").cast(own).alias(key), *out.columns[1:])


class Sessions(Keyed):
    """`head` holds the last sequence and whether the session has ended; a timer ends it for good."""

    order = "sequence"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle, self.head = handle, handle.getValueState("head", "last long, ended boolean")

    def take(self, key, pdf, timers):
        last, ended = self.head.get() if self.head.exists() else (0, False)
        terminal = pdf["kind"].isin(list(TERMINAL)).to_numpy()
        ok = accepted(pdf["sequence"].to_numpy(), terminal, last, ended)
        if ok.any():
            i = ok.nonzero()[0][-1]
            ended = bool(terminal[i])
            self.head.update((int(pdf["sequence"].iloc[i]), ended))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if ended:
                self.handle.registerTimer(pdf["at"].iloc[i].value // 1_000_000 + self.ttl_ms)
        return pdf.assign(session_id=key, ok=ok)[["session_id", "sequence", "kind", "ok"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.head.clear()
        yield pd.DataFrame({"session_id": [key[0]], "sequence": [0], "kind": ["expired"], "ok": [True]})


def session_log(events: DataFrame, ttl_ms: int = TTL_MS, late: str = "0 seconds") -> DataFrame:
    """R1, R2, R4 as a stream: events(session_id, sequence, kind, at) with `ok`: whether each follows the one before it and the
    session has not ended twice. Refused events are rows too, for a side table. A session that has ended is forgotten once
    event time is ttl_ms beyond its end, and says so by a row `expired`; an accepted event before that keeps it."""
    use_store(events.sparkSession)
    keyed = events.select("session_id", "sequence", "kind", "at").withWatermark("at", late).groupBy("session_id")
    return keyed.transformWithStateInPandas(Sessions(ttl_ms), "session_id long, sequence long, kind string, ok boolean", "append", "eventTime")


class Jobs(Dealt):
    """The state of a job; a move that is not legal leaves it as it is."""

    kept = "state string"

    def take(self, pdf, now):
        was, ok = [], []
        for job, to in zip(pdf["key"], pdf["state"], strict=True):
            old = now[job][0] if now[job] else None
            legal = to == "queued" if old is None else (old, to) in MOVES
            was.append(old)
            ok.append(legal)
            if legal:
                now[job] = (to,)
        return pdf.assign(was=was, ok=ok)[["key", "seq", "state", "was", "ok"]]


def job_log(moves: DataFrame) -> DataFrame:
    """R6 as a stream: moves(job_id, seq, state) with the state before and whether the move is legal. A job begins as queued;
    refused moves change nothing."""
    return _dealt(moves.select("job_id", "seq", "state"), "job_id", Jobs(), "seq long, state string, was string, ok boolean")


def job_moves(moves: DataFrame) -> DataFrame:
    """R6 over a finished log: the legal moves of a job are its first `queued`, the first `running` after that, and the first
    end after that. Windows, so that a job of any length is sorted on disk rather than held."""
    job, seq = Window.partitionBy("job_id"), F.col("seq")
    first = lambda states, after: F.min(F.when(F.col("state").isin(*states) & (seq > after), seq)).over(job)
    out = moves.withColumn("queued", F.min(F.when(F.col("state") == "queued", seq)).over(job))
    out = out.withColumn("running", first(("running",), F.col("queued"))).withColumn("over", first(OVER, F.col("running")))
    was = F.when(seq > F.col("over"), F.min_by("state", F.when(seq == F.col("over"), seq)).over(job)).when(seq > F.col("running"), "running").when(seq > F.col("queued"), "queued")
    return out.select("job_id", "seq", "state", was.alias("was"), F.coalesce(seq.isin(F.col("queued"), F.col("running"), F.col("over")), F.lit(False)).alias("ok"))


class InFlight(Dealt):
    """The job that is open for a target, and how many requests it serves."""

    kept = "job string, n long"

    def take(self, pdf, now):
        out = []
        for target, seq, request, over in zip(pdf["key"], pdf["seq"], pdf["request"], pdf["over"], strict=True):
            job, n = now[target] or (None, 0)
            if not over:
                joined = job is not None
                now[target] = job, n = job if joined else request, n + 1
                out.append((target, seq, request, job, joined, None))
            elif job is not None:
                out.append((target, seq, None, job, None, n))
                now[target] = None
        return pd.DataFrame(out, columns=["key", "seq", "request", "job", "joined", "served"]).astype({"joined": "boolean", "served": "Int64"})


def _asked(log: DataFrame) -> DataFrame:
    """Requests and ends of jobs by target; other states of a job do not matter here."""
    return log.select(T.canonical_target("target").alias("target"), "seq", "request", F.coalesce(F.col("state").isin(*OVER), F.lit(False)).alias("over")).filter("over or request is not null")


def in_flight(log: DataFrame) -> DataFrame:
    """R7 as a stream: log(target, seq, request, state) of requests (state null) and of states of the open job of a target
    (request null). A request joins the open job of its target, or opens one that takes its name; the job's end closes it,
    and then a row tells how many requests it served. Requests that arrive in different batches join the same job."""
    return _dealt(_asked(log), "target", InFlight(), "seq long, request string, job string, joined boolean, served long")


def in_flight_jobs(log: DataFrame) -> DataFrame:
    """R7 over a finished log: the requests between two ends of a target are served by the first of them; an end without
    requests before it closes nothing."""
    before = Window.partitionBy("target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = _asked(log).withColumn("turn", F.coalesce(F.sum(F.col("over").cast("long")).over(before), F.lit(0)))
    turn = Window.partitionBy("target", "turn")
    own = F.when(~F.col("over"), F.col("seq"))
    rows = rows.withColumns({"job": F.min_by("request", own).over(turn), "first": F.min(own).over(turn), "served": F.count(own).over(turn)})
    return rows.filter("served > 0").select("target", "seq", "request", "job", F.when(~F.col("over"), F.col("seq") > F.col("first")).alias("joined"), F.when(F.col("over"), F.col("served")).alias("served"))


def run_once(stream: DataFrame, path: str, checkpoint: str, ok: str | None = None) -> None:
    """Writes what a stream has by now as Parquet below path; rows that do not hold `ok` go to the side table path/refused
    and the others to path/rows. A batch that is repeated after a crash replaces its own files."""
    def put(rows: DataFrame, number: int) -> None:
        parts = {"rows": rows} if ok is None else {"rows": rows.filter(ok), "refused": rows.filter(f"not ({ok})")}
        if len(parts) > 1:
            rows.persist()
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        rows.unpersist()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
