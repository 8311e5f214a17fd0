"""Steps that depend on each other: run in parallel, with failures passed on."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from time import monotonic
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import reach, validate_steps


class Step(NamedTuple):
    name: str
    needs: list[str]
    run: Callable[[dict], Any]  #: gets the outcomes so far


class Outcome(NamedTuple):
    status: str  #: completed, failed or skipped
    value: Any = None
    error: Exception | None = None
    seconds: float = 0.0


def run(steps: list[Step], parallel: int = 8, seen: Callable[[str, str], None] = lambda name, what: None) -> dict[str, Outcome]:
    """Outcome of each step. A step starts as soon as all it needs are completed; one that needs a failed or skipped
    step, directly or not, is skipped, and the others go on. ValueError if the steps do not form an order. Steps submit
    their Spark jobs from threads of their own."""
    faults = {k: v for k, v in validate_steps([(s.name, s.needs) for s in steps]).items() if v}
    if faults:
        raise ValueError(f"steps cannot be ordered: {faults}")
    done: dict[str, Outcome] = {}
    waiting, running = {s.name: s for s in steps}, {}

    def timed(step):
        began = monotonic()
        try:
            return Outcome("completed", step.run(done), None, monotonic() - began)
        except Exception as e:  # a step's failure is its outcome
            return Outcome("failed", None, e, monotonic() - began)

    with ThreadPoolExecutor(parallel) as pool:
        while waiting or running:
            moved = True
            while moved:
                moved = False
                for name, step in list(waiting.items()):
                    if all(n in done for n in step.needs):
                        del waiting[name]
                        moved = True
                        if all(done[n].status == "completed" for n in step.needs):
                            seen(name, "started")
                            running[pool.submit(timed, step)] = name
                        else:
                            done[name] = Outcome("skipped")
                            seen(name, "skipped")
            for f in wait(running, return_when=FIRST_COMPLETED).done if running else ():
                name = running.pop(f)
                done[name] = f.result()
                seen(name, done[name].status)
    return done


def states(steps: DataFrame, needs: DataFrame, failed: DataFrame) -> DataFrame:
    """G3 as a plan: steps(step) with their state when those of failed(step) fail; needs(step, needs)."""
    edges = needs.select(F.col("needs").alias("a"), F.col("step").alias("b"))
    lost = reach(edges, edges.join(failed.select(F.col("step").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("node"))).select(F.col("node").alias("step"), F.lit("skipped").alias("state"))
    own = failed.select("step").distinct().withColumn("own", F.lit("failed"))
    out = steps.join(lost, "step", "left").join(own, "step", "left")
    return out.select("step", F.coalesce("state", "own", F.lit("completed")).alias("state"))
