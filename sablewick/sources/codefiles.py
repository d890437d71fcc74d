"""``codefiles``: a Python data source over a source tree.

The built-in file sources drop names that begin with ``_`` or ``.``; this one
leaves that to the predicates.  Directories are listed on the driver level by
level down to ``depth`` to make partitions; executors walk what lies below, so a
large tree is scanned in parallel.  Ignored directories are pruned before they
are entered, and symbolic links are not followed.  The root must be reachable
from all executors.

Options: ``path`` (required), ``extensions`` and ``ignore`` (comma-separated;
the defaults apply where not given, ``*`` takes every extension), ``hidden``
(``true`` takes names that begin with a dot), ``depth`` (2).

Columns: relative_path, content (UTF-8, bad bytes replaced), file_extension,
size, error.  A file that cannot be read gives a row with a null content and the
error, and the scan goes on.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sablewick.functions import paths, values

SCHEMA = "relative_path string, content string, file_extension string, size long, error string"


def extension_of(path: str) -> str:
    return os.path.splitext(path)[1] if not path.endswith(".") else "."


class Rules:
    """What is taken, decided once per entry."""

    def __init__(self, options: dict):
        wanted = options.get("extensions")
        self.extensions = None if wanted == "*" else set(paths.extensions_from_env(wanted) if wanted else values.EXTENSIONS)
        patterns = [p.strip() for p in options["ignore"].split(",") if p.strip()] if "ignore" in options else values.IGNORE_PATTERNS
        self.ignored = re.compile(paths.ignore_regex(patterns))
        self.hidden = options.get("hidden", "true").lower() == "true"

    def enters(self, relative: str) -> bool:
        return not self.ignored.search(relative) and (self.hidden or not relative.rsplit("/", 1)[-1].startswith("."))

    def takes(self, relative: str) -> bool:
        return self.enters(relative) and (self.extensions is None or extension_of(relative) in self.extensions)


class Part(InputPartition):
    """A directory (walked below, or its own files only) to read."""

    def __init__(self, directory: str, below: bool):
        super().__init__(directory)
        self.directory, self.below = directory, below


class CodeFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.rules = os.path.abspath(options["path"]), Rules(options)
        self.depth = int(options.get("depth", 2))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on file_extension are applied before a file is opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("file_extension",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.rules.extensions = own if self.rules.extensions is None else self.rules.extensions & own
            else:
                yield f

    def partitions(self) -> list[Part]:
        level, parts = [""], []
        for _ in range(self.depth):
            parts += [Part(d, False) for d in level]
            level = [f"{d}/{e.name}".lstrip("/") for d in level for e in self._entries(d) if e.is_dir(follow_symlinks=False) and self.rules.enters(f"{d}/{e.name}".lstrip("/"))]
        return parts + [Part(d, True) for d in level]

    def _entries(self, relative: str) -> list[os.DirEntry]:
        try:
            return sorted(os.scandir(os.path.join(self.root, relative)), key=lambda e: e.name)
        except OSError:
            return []

    def listed(self, partition: Part) -> Iterator[tuple[str, str]]:
        """(relative path, path) of the files to be taken, none of them opened."""
        stack = [partition.directory]
        while stack:
            here = stack.pop()
            for e in self._entries(here):
                relative = f"{here}/{e.name}".lstrip("/")
                if e.is_dir(follow_symlinks=False):
                    if partition.below and self.rules.enters(relative):
                        stack.append(relative)
                elif e.is_file(follow_symlinks=False) and self.rules.takes(relative):
                    yield relative, e.path

    def read(self, partition: Part) -> Iterator[tuple]:
        for relative, path in self.listed(partition):
            try:
                with open(path, "rb") as f:
                    raw = f.read()
                yield relative, raw.decode("utf-8", "replace"), extension_of(relative), len(raw), None
            except OSError as failed:
                yield relative, None, extension_of(relative), None, str(failed)


class StatsReader(CodeFilesReader):
    """What is known of files without opening them."""

    def read(self, partition: Part) -> Iterator[tuple]:
        for relative, path in self.listed(partition):
            try:
                seen = os.stat(path)
                yield relative, seen.st_size, seen.st_mtime_ns
            except OSError:
                continue  # gone since it was listed


class CodeStats(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codestats"

    def schema(self) -> str:
        return "relative_path string, size long, modified long"

    def reader(self, schema) -> DataSourceReader:
        return StatsReader(dict(self.options))


class CodeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codefiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CodeFilesReader(dict(self.options))


def read_tree(spark, path: str, **options):
    """A DataFrame of the files below ``path``."""
    spark.dataSource.register(CodeFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("codefiles").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def read_stats(spark, path: str, **options):
    """(relative_path, size, modified) of the files below ``path``, none of them opened."""
    spark.dataSource.register(CodeStats)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("codestats").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def root_ignore_patterns(path: str) -> list[str]:
    """Patterns of every ``.*ignore`` file in the root."""
    found: list[str] = []
    for name in sorted(os.listdir(path)):
        if name.startswith(".") and name.endswith("ignore") and os.path.isfile(os.path.join(path, name)):
            with open(os.path.join(path, name), encoding="utf-8", errors="replace") as f:
                found += paths.parse_ignore_file(f.read())
    return found
