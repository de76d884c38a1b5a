"""A file tree as a Spark data source: listed and read by the executors, a part of the tree each.

The driver lists as many levels of directories as it takes to have ``parts`` of them, and no files but those beside
these; a task lists and reads what is below its directories.

``corpusloom.session.ship(spark)``, ``spark.dataSource.register(TreeSource)`` and then
``spark.read.format("corpus_tree").option("exclude", "a/,*.bak").load("/corpus")``.  Names that start with a dot
are files like others, links are rows that are never followed, what can't be read is a row with its error, and a file
of more than ``maxFileBytes`` is a row of kind ``oversize``, without content and with its reason.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.globs import compiled

SCHEMA = "path string, kind string, target string, size_bytes long, mtime_ns long, nlink long, dev long, ino long, content binary, error string"


@dataclass
class Chunk(InputPartition):
    """Directories that one task lists, with all below or by themselves."""

    root: str
    tops: list[tuple[str, bool]]


def included(path: str, patterns: list[str]) -> bool:
    out = False
    for found in map(compiled, patterns):
        if found and re.match(found[0], path, re.S):
            out = not found[1]
    return out


def listing(root: str, include: list[str], exclude: list[str], top: str = "", deep: bool = True) -> Iterator[tuple]:
    """(relative path, kind, link target, size, mtime, links, device, object, error) of a directory, in name order.

    Directories come as kind ``directory`` where not ``deep``, and are gone into where it is.
    """
    waiting = [top]
    while waiting:
        here = waiting.pop()
        try:
            with os.scandir(os.path.join(root, here)) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            yield (here or ".", "unreadable", None, None, None, None, None, None, str(e))
            continue
        for e in entries:
            rel = f"{here}/{e.name}" if here else e.name
            try:
                folder = e.is_dir(follow_symlinks=False)
            except OSError:
                folder = False
            if not folder:
                if row := _entry(root, rel, include, exclude):
                    yield row
            elif not included(rel + "/_", exclude):
                if deep:
                    waiting.append(rel)
                else:
                    yield (rel, "directory", None, None, None, None, None, None, None)


def _entry(root: str, rel: str, include: list[str], exclude: list[str]) -> tuple | None:
    full = os.path.join(root, rel)
    try:
        s = os.lstat(full)
        if stat.S_ISLNK(s.st_mode):
            if included(rel, exclude):
                return None
            target = os.readlink(full)
            kind = "link-broken" if not os.path.exists(full) else "link-directory" if os.path.isdir(full) else "link-file" if os.path.isfile(full) else "link-other"
            return (rel, kind, target, None, None, None, None, None, None)
    except OSError as e:
        return (rel, "unreadable", None, None, None, None, None, None, str(e))
    if not included(rel, include):
        return None
    if included(rel, exclude):
        return (rel, "excluded", None, s.st_size, s.st_mtime_ns, s.st_nlink, s.st_dev, s.st_ino, None)
    return (rel, "file" if stat.S_ISREG(s.st_mode) else "other", None, s.st_size, s.st_mtime_ns, s.st_nlink, s.st_dev, s.st_ino, None)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.include = [x for x in options.get("include", "*").split(",") if x]
        self.exclude = [x for x in options.get("exclude", "").split(",") if x]
        self.parts = int(options.get("parts", 64))
        self.limit = int(options.get("maxFileBytes", 100 << 20))
        self.single = not os.path.isdir(self.root) or os.path.islink(self.root)

    def partitions(self) -> list[Chunk]:
        """Directories dealt to tasks, once a level of the tree has enough of them."""
        if self.single:
            return [Chunk(os.path.dirname(self.root) or ".", [])]
        alone, level = [], [""]
        while level and len(level) < self.parts:
            below = [row[0] for top in level for row in listing(self.root, self.include, self.exclude, top, False) if row[1] == "directory"]
            alone += [(top, False) for top in level]
            level = below
        tops = alone + [(top, True) for top in level]
        return [Chunk(self.root, tops[i :: self.parts]) for i in range(min(self.parts, len(tops)))]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if self.single:
            rows = iter(filter(None, [_entry(partition.root, os.path.basename(self.root), self.include, self.exclude)]))
        else:
            rows = (row for top, deep in partition.tops for row in listing(self.root, self.include, self.exclude, top, deep))
        for row in rows:
            if row[1] != "directory":
                yield self.loaded(partition.root, row)

    def loaded(self, root: str, row: tuple) -> tuple:
        """A listed file with its content, or with why there is none."""
        path, kind, target, size, mtime, nlink, dev, ino, error = row
        content = None
        if kind == "file" and size > self.limit:
            kind, error = "oversize", f"{size} bytes, of {self.limit} at most"
        elif kind == "file":
            try:
                fd = os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW)
                with os.fdopen(fd, "rb") as f:
                    content = f.read()
            except OSError as e:
                kind, error = "unreadable", str(e)
        return (path, kind, target, size, mtime, nlink, dev, ino, content, error)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
