"""Settings in layers, the state of a working tree, and vectors from a service."""

from __future__ import annotations

import hashlib
import os
import random
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T


class SettingsError(ValueError):
    pass


def parse_yaml(text: str | None) -> dict:
    """A file's settings; none of an empty one. SettingsError if it is no YAML."""
    try:
        import yaml
    except ImportError as e:
        raise SettingsError("reading YAML needs the yaml package") from e
    try:
        found = yaml.safe_load(text or "")
    except yaml.YAMLError as e:
        raise SettingsError(str(e)) from e
    return found if isinstance(found, dict) else {}


def settings(file: str | None, names: dict[str, str], given: dict, defaults: dict, check: Callable[[dict], Iterable[str]] = lambda s: (), env: dict | None = None) -> dict:
    """Defaults, then the file, then variables of the environment (names: variable to setting), then what is given; each
    replaces the one before as a whole, empty variables and None do not. check lists what is wrong, which is an error."""
    env = os.environ if env is None else env
    merged = defaults | parse_yaml(file) | {k: env[v] for v, k in names.items() if env.get(v)} | {k: v for k, v in given.items() if v is not None}
    if wrong := list(check(merged)):
        raise SettingsError("; ".join(wrong))
    return merged


#: States of a working tree whose paths count as changed.
STATES = ("diff", "modified", "created", "deleted", "renamed", "not_added", "staged")


def changes_since(changes: DataFrame, repository: bool = True, shallow: bool = False, detached: bool = False, ref_known: bool = True) -> tuple[DataFrame | None, str | None]:
    """Distinct paths of a diff and of the working tree's states (path, state; of a rename the new path), or None
    and why everything has to run. An unknown reference is an error."""
    reason = "Not a git repo" if not repository else "Shallow clone detected" if shallow else "Detached HEAD" if detached else None
    if reason:
        return None, reason
    if not ref_known:
        raise ValueError("the reference to compare with is unknown")
    return changes.filter(F.col("state").isin(*STATES)).select("path").distinct(), None


def files_of_commits(lines: DataFrame) -> DataFrame:
    """(hash, path) of lines (hash, value), blank ones left out."""
    return lines.select("hash", F.trim("value").alias("path")).filter("path != ''")


def decide(changed: int, known: int, total: int) -> str:
    """I2, I3: 'none' if nothing changed, 'some' if a cache is there and not all of it changed, else 'all'."""
    return "none" if known and not changed else "some" if known and changed < total else "all"


def reused(documents: DataFrame, affected: DataFrame, present: DataFrame) -> DataFrame:
    """documents(renderer, filename) with whether what was written before stays: unaffected and still there."""
    hit, there = affected.select("renderer").distinct().withColumn("hit", F.lit(True)), present.select("filename").distinct().withColumn("there", F.lit(True))
    out = documents.join(hit, "renderer", "left").join(there, "filename", "left")
    return out.select(*documents.columns, (F.col("hit").isNull() & F.col("there").isNotNull()).alias("reused"))


def exit_code(stale: int, unknown: bool) -> int:
    """0 if all documents are fresh, 1 if some are stale, 2 if that cannot be told."""
    return 2 if unknown else int(stale > 0)


#: Texts of one request, tries beside the first, and the first wait in milliseconds.
BATCH, RETRIES, BASE_MS = 100, 3, 1000


def embedder(post: Callable[[list[str]], list[dict]], dims: int, batch: int = BATCH, retries: int = RETRIES, base_ms: float = BASE_MS, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """A function from rows(key, content) to (key, embedding). post(texts) asks the service for one batch and gives
    {'index', 'embedding'} in any order; it is tried again with growing waits. Executors call it, so it must pickle."""
    def ask(texts):
        for attempt in range(retries + 1):
            try:
                got = {r["index"]: r["embedding"] for r in post(texts)}
                if sorted(got) != list(range(len(texts))) or any(len(v) != dims for v in got.values()):
                    raise ValueError("the service gave other vectors than asked for")
                return [got[i] for i in range(len(texts))]
            except Exception:
                if attempt == retries:
                    raise
                sleep(base_ms * 2**attempt * (0.5 + random.random()) / 1000)
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ask(part.column(1).to_pylist()), pa.list_(pa.float32()))], names=["key", "embedding"])

    return lambda rows: rows.select("key", "content").mapInArrow(run, "key string, embedding array<float>")


def repository_print(files: DataFrame, by: str | None = None) -> DataFrame:
    """one hash of all paths and hashes, in the order of paths as people sort them, of each repository (`by`) or of all;
    files(by, path, hash). (by, fingerprint); none of no files.

    A hash is made of a repository's lines one after the other: they are sorted on disk and pass through one task, which
    holds a batch of them and not the repository.
    """
    repo = F.col(by).cast("string") if by else F.lit("")
    rows = files.select(repo.alias("repo"), F.concat_ws(":", "path", "hash").alias("line"), F.collate("path", "UNICODE").alias("k"), "path")
    ordered = rows.repartition("repo").sortWithinPartitions("repo", "k", "path").select("repo", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, made = None, None
        for b in batches:
            done = []
            for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if made is None or name != repo:
                    done += [(repo, made)] if made else []
                    repo, made = name, hashlib.sha256(line.encode())
                else:
                    made.update(b"\n" + line.encode())
            yield prints(done)
        yield prints([(repo, made)] if made else [])

    def prints(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.string()), pa.array([m.hexdigest() for _, m in done], pa.string())], names=["repo", "fingerprint"])

    found = ordered.mapInArrow(run, "repo string, fingerprint string")
    return found.withColumnRenamed("repo", by) if by else found.select("fingerprint")
