"""Event logs of sessions and states of jobs, in batch and as streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Kinds of events that end a session, and the state each leads to.
TERMINAL = {"final": "completed", "cancelled": "cancelled", "error": "failed"}
#: Legal moves of a job.
MOVES = (("queued", "running"), ("running", "completed"), ("running", "failed"))
PROGRESS = {"queued": 5, "running": 50, "completed": 100, "failed": 100}


def check_sequence(events: DataFrame) -> DataFrame:
    """Batch form: each event with whether it follows the one before it without a gap."""
    before = F.lag("sequence").over(Window.partitionBy("session_id").orderBy("sequence"))
    return events.withColumn("ok", F.col("sequence") == F.coalesce(before, F.lit(0)) + 1)


def replay(events: DataFrame, ack: int) -> DataFrame:
    """R3, O14."""
    return events.filter(F.col("sequence") > ack).orderBy("session_id", "sequence")


def status(events: DataFrame) -> DataFrame:
    """State of each session by its last event."""
    last = events.groupBy("session_id").agg(F.max_by("kind", "sequence").alias("kind"), F.max("sequence").alias("last"))
    state = F.lit("active")
    for k, v in TERMINAL.items():
        state = F.when(F.col("kind") == k, v).otherwise(state)
    return last.withColumn("status", state)


def accepted(sequence, terminal, last: int, ended: bool):
    """Which events, in the order of their sequence, follow the one before without a gap; a second end in a row is
    refused, and so is all that stands behind what is refused. An event after the end opens the session again."""
    fresh = (sequence > last) & (np.diff(sequence, prepend=last) != 0)
    ok = fresh & (sequence == last + np.cumsum(fresh))
    at = np.flatnonzero(ok)
    before = np.concatenate([[ended], terminal[at][:-1]]) if len(at) else np.zeros(0, bool)
    twice = np.flatnonzero(terminal[at] & before.astype(bool))
    if len(twice):
        ok[at[twice[0]] :] = False
    return ok


#: Fixed value: milliseconds for which a session that has ended is kept.
TTL_MS = 24 * 3600 * 1000


def append(stream: DataFrame, output_mode: str = "append", ttl_ms: int = TTL_MS) -> DataFrame:
    """R1, R4 as a stream: session_id, sequence, kind with `ok`; events out of sequence are marked, not lost. A session that
    has ended is forgotten ttl_ms after its last event."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        last, ended = state.get if state.exists else (0, False)
        sequence, terminal = pdf["sequence"].to_numpy(), pdf["kind"].isin(list(TERMINAL)).to_numpy()
        ok = accepted(sequence, terminal, last, ended)
        if ok.any():
            i = np.flatnonzero(ok)[-1]
            last, ended = int(sequence[i]), bool(terminal[i])
        state.update((last, ended))
        if ended:
            state.setTimeoutDuration(ttl_ms)
        yield pdf.assign(session_id=key[0], ok=ok)[["session_id", "sequence", "kind", "ok"]]

    return stream.groupBy("session_id").applyInPandasWithState(run, "session_id long, sequence long, kind string, ok boolean", "last long, ended boolean", output_mode, GroupStateTimeout.ProcessingTimeTimeout)


def kept(events: DataFrame, now, ttl_ms: int = TTL_MS) -> DataFrame:
    """R4 in batch: events of sessions that have not ended, or not longer than ttl_ms before now; events(session_id, sequence,
    kind, at)."""
    last = events.groupBy("session_id").agg(F.max_by(F.struct("kind", "at"), "sequence").alias("e"))
    gone = last.filter(F.col("e.kind").isin(*TERMINAL) & (F.col("e.at") + F.make_dt_interval(secs=F.lit(ttl_ms / 1000)) <= now))
    return events.join(gone.select("session_id"), "session_id", "left_anti")


def fan_out(stream: DataFrame, listeners: list, checkpoint: str, ack: dict | None = None, **trigger):
    """A running query that hands each batch to every listener(rows, batch number). A listener that fails stops the query,
    which starts again where it was; ack: sequences from which sessions resume, earlier events are not sent again."""
    def send(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            if ack:
                seen = rows.sparkSession.createDataFrame(list(ack.items()), "session_id long, seen long")  # sessions that one process resumes
                rows = rows.join(F.broadcast(seen), "session_id", "left").filter(F.col("sequence") > F.coalesce("seen", F.lit(0))).drop("seen")
            for listen in listeners:
                listen(rows, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def cancel(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The event that ends each of sessions(session_id) that still runs."""
    return status(events).join(sessions, "session_id").filter("status = 'active'").select("session_id", (F.col("last") + 1).alias("sequence"), F.lit("cancelled").alias("kind"))


def join_in_flight(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests(request, target, seq) with the job that serves each: that which is queued or running for the target, else
    that of the target's first request; joined tells whether it was there before. jobs(job, target, state)."""
    target = T.canonical_target("target")
    active = jobs.filter(F.col("state").isin("queued", "running")).groupBy(target.alias("key")).agg(F.min("job").alias("active"))
    r = requests.withColumn("key", target)
    first = r.groupBy("key").agg(F.min(F.struct("seq", "request")).alias("f"))  # a row for each target, joined back: a hot one is split
    out = r.join(first, "key").join(active, "key", "left")
    own = F.col("f.request") == F.col("request")
    return out.select("request", "key", F.coalesce("active", F.col("f.request")).alias("job"), (F.col("active").isNotNull() | ~own).alias("joined"))


def progress(state) -> Column:
    """Percent of a job's state."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair)), T.col(state))


def check_moves(transitions: DataFrame) -> DataFrame:
    """(job_id, seq, state) with whether the move is legal; a job begins as queued."""
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("seq"))
    legal = F.concat_ws(">", before, "state").isin(*(f"{a}>{b}" for a, b in MOVES))
    return transitions.withColumn("ok", F.when(before.isNull(), F.col("state") == "queued").otherwise(legal))


def by_window(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """A7 over time: events(ts, event_type) per window; on a stream late rows are dropped after `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
