"""A folder as a table of its files, by a Python data source that never lists what is ignored.

The planner lists folders level by level until there are enough of them to share out; each task lists and reads the folders
below its own. A folder that is hidden, always ignored or named by an ignore file on the way to it is not entered, and a
file is opened only after its name and size have passed.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.operators.incremental import glob_regex
from factloom.sources.files import BINARY, IGNORED, MAX_BYTES, ignore_rules

SCHEMA = "path string, size long, extension string, content binary, warning string"
#: Folders that are enough to share out, folders that the planner lists at most, bytes of contents in a batch.
SHARED, LISTED, BATCH = 64, 512, 4 << 20


class Entry(NamedTuple):
    name: str
    folder: bool
    size: int


class Local:
    """Folders that every process sees by the same path; links are not followed."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, path: str) -> list[Entry]:
        with os.scandir(os.path.join(self.root, path)) as found:
            return [Entry(e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_size) for e in found if not e.is_symlink()]

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()


class Remote:
    """Folders of a store that pyarrow knows by its address."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root)

    def entries(self, path: str) -> list[Entry]:
        return [Entry(e.base_name, e.type == pafs.FileType.Directory, e.size or 0) for e in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{path}".rstrip("/")))]

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()


def store(root: str) -> Local | Remote:
    return Local(root.removeprefix("file://")) if root.startswith(("/", "file:")) or "://" not in root else Remote(root)


class Folder(NamedTuple):
    """A folder by its path below the root ('' or ending in /), with the rules of ignore files above it: where each stands, its
    pattern, whether it ignores."""

    path: str
    rules: tuple[tuple[str, str, bool], ...] = ()

    def ignores(self, name: str, folder: bool) -> bool:
        verdict, path = False, self.path + name
        for base, pattern, no in self.rules:
            at = path[len(base) :]
            if re.match(pattern, at, re.S) or folder and pattern.endswith("/.*$") and re.match(pattern, at + "/", re.S):
                verdict = no
        return verdict


def visit(files: Local | Remote, folder: Folder, more: list[str]) -> tuple[list[Entry], list[Folder]]:
    """Files of a folder that are wanted, too large ones too, and its folders that are to be entered. Nothing below an ignored
    folder comes back, whatever later rules say."""
    entries = files.entries(folder.path)
    if any(e.name == ".gitignore" and not e.folder for e in entries):
        own = ignore_rules(files.read(f"{folder.path}.gitignore").decode("utf-8", "replace"))
        folder = Folder(folder.path, (*folder.rules, *((folder.path, p, no) for p, no in own)))
    seen = sorted((e for e in entries if not e.name.startswith(".") and not folder.ignores(e.name, e.folder)), key=lambda e: e.name)
    wanted = [e for e in seen if not e.folder and extension(e.name)[1:].lower() not in BINARY and not any(re.match(g, folder.path + e.name, re.S) for g in more)]
    return wanted, [Folder(f"{folder.path}{e.name}/", folder.rules) for e in seen if e.folder and e.name not in IGNORED]


def extension(name: str) -> str:
    return os.path.splitext(name)[1]


class Share(InputPartition):
    """Folders of one task: some with all that is below, others with their own files only."""

    def __init__(self, whole: list[Folder], own: list[Folder]):
        self.whole, self.own = whole, own


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.contents = options["path"], options.get("contents", "true") == "true"
        self.more = [glob_regex(g) for g in json.loads(options.get("ignore", "[]"))]

    def partitions(self) -> list[Share]:
        files, open_, own = store(self.root), deque([Folder("")]), []
        while open_ and len(open_) < SHARED and len(own) < LISTED:
            folder = open_.popleft()
            own.append(folder)
            open_ += visit(files, folder, self.more)[1]
        shares = [Share([f], []) for f in open_]
        return shares + [Share([], own[i : i + 16]) for i in range(0, len(own), 16)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, todo, rows, size = store(self.root), deque((f, True) for f in partition.whole), [], 0
        todo += ((f, False) for f in partition.own)
        while todo:
            folder, deep = todo.popleft()
            wanted, below = visit(files, folder, self.more)
            todo += ((f, True) for f in below) if deep else ()
            for e in wanted:
                path, large = folder.path + e.name, e.size > MAX_BYTES
                content = files.read(path) if self.contents and not large else None
                rows.append((path, e.size, extension(e.name), content, f"{e.size} bytes, more than {MAX_BYTES}" if large else None))
                size += len(content or b"")
                if size >= BATCH or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "size", "extension", "content", "warning"])


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "factloom_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, ignore: list[str] = (), contents: bool = True) -> DataFrame:
    """Files below root but hidden, binary and ignored ones; those above 2 MiB come without contents and with a
    warning. Ignore files of all folders hold for what is below them. contents: whether files are opened at all."""
    spark.dataSource.register(Tree)
    return spark.read.format("factloom_tree").option("ignore", json.dumps(list(ignore))).option("contents", str(contents).lower()).load(root.rstrip("/"))
