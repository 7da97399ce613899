"""A data source that walks a tree of folders: spark.read.format("folder_tree").load(root) after register().

Folders are rows too, empty ones among them, and names that begin with a dot are
seen. The driver lists only the upper folders, until there are enough to deal out;
each is walked by a task, which looks for markers and ignored names before it goes
down. A folder that cannot be read is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.sources.readers import IGNORED, MARKER, ignore_rule
from shelfmark.sources.stores import opened

SCHEMA = "path string, is_dir boolean, size long, modified timestamp, n_entries long"


@dataclass
class Folders(InputPartition):
    """Folders to walk to their ends, and folders of which only the entries themselves are wanted."""

    deep: list[str]
    flat: list[str]


class Walk:
    """What is seen below a root: rules are those of an ignore file, over paths relative to the root; the last that fits decides."""

    def __init__(self, root: str, lines: list[str], marker: str):
        self.store, self.root = opened(root)
        self.root = self.root.rstrip("/") or "/"
        self.rules = [(re.compile(pattern), back) for pattern, back in filter(None, map(ignore_rule, lines))]
        self.marker = marker

    def taken(self, path: str, is_dir: bool) -> bool:
        name, hit = path[len(self.root.rstrip("/")) :] + ("/" if is_dir else ""), False
        for pattern, back in self.rules:
            if pattern.search(name):
                hit = not back
        return not hit

    def entries(self, folder: str) -> list[fs.FileInfo] | None:
        """Entries of a folder, by name; None if it holds the marker or cannot be read."""
        try:
            found = self.store.get_file_info(fs.FileSelector(folder))
        except OSError:
            return None
        if self.marker and any(e.base_name == self.marker for e in found):
            return None
        return sorted((e for e in found if e.type in (fs.FileType.File, fs.FileType.Directory) and self.taken(e.path, e.type == fs.FileType.Directory)), key=lambda e: e.base_name)

    def rows(self, folder: str, deep: bool) -> Iterator[tuple]:
        """The entries of a folder and, where it is walked deep, of those below; a folder's own row comes from the one that walks it."""
        waiting = [folder]
        while waiting:
            at = waiting.pop()
            found = self.entries(at)
            if found is None:
                continue
            if at != self.root:
                own = self.store.get_file_info(at)
                yield at, True, None, own.mtime, len(found)
            for e in found:
                if e.type == fs.FileType.File:
                    yield e.path, False, e.size, e.mtime, None
                elif deep:
                    waiting.append(e.path)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.lines = [*(IGNORED if options.get("usual", "true") == "true" else []), *(options.get("ignore") or "").split("\n")]
        self.marker = options.get("marker", MARKER)
        self.wanted = int(options.get("partitions", "64"))

    def partitions(self) -> list[InputPartition]:
        """Level by level, until a level has as many folders as are wanted; those above are listed flat."""
        walk = Walk(self.root, self.lines, self.marker)
        flat, level = [], [walk.root]
        while level and len(level) < self.wanted:
            below = [(at, walk.entries(at)) for at in level]
            flat += [at for at, found in below if found is not None]
            level = [e.path for _, found in below for e in found or [] if e.type == fs.FileType.Directory]
        groups: list[InputPartition] = [Folders(level[i :: self.wanted], []) for i in range(min(self.wanted, len(level)))]
        groups += [Folders([], flat[i :: self.wanted]) for i in range(min(self.wanted, len(flat)))]
        return groups or [Folders([], [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Folders)
        walk = Walk(self.root, self.lines, self.marker)
        for deep, folders in ((True, partition.deep), (False, partition.flat)):
            for folder in folders:
                yield from walk.rows(folder, deep)


class FolderTree(DataSource):
    """Options: path (of the root), ignore (lines of an ignore file after the usual ones), usual (false leaves those out), marker ("" for none), partitions."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderTree)
