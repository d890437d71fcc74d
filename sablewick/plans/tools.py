"""The engine's tools as named calls with plain arguments and text answers.

``index_codebase`` works in the background (a thread that submits Spark jobs in
its own job group); the others answer at once.  Wrong arguments give an answer
that says so, never an exception.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import functions as F

from sablewick.functions import text as text_
from sablewick.functions import values
from sablewick.operators import split
from sablewick.plans.engine import Engine

SHOWN_CHARS = 5000


class Tools:
    def __init__(self, engine: Engine):
        self.engine = engine
        self._running: dict[str, threading.Thread] = {}
        self._percent: dict[str, int] = {}
        self._lock = threading.Lock()

    def call(self, name: str, arguments: dict) -> str:
        known: dict[str, Callable[..., str]] = {"index_codebase": self.index_codebase, "search_code": self.search_code, "clear_index": self.clear_index, "get_indexing_status": self.get_indexing_status}
        if name not in known:
            return f"Error: unknown tool {name!r}."
        try:
            return known[name](**arguments)
        except TypeError as wrong:
            return f"Error: {wrong}."
        except (ValueError, NotADirectoryError) as wrong:
            return f"Error: {wrong}"

    def _path(self, path: str) -> str:
        path = os.path.abspath(path)
        if not os.path.isdir(path):
            raise NotADirectoryError(f"{path!r} is not a directory.")
        return path

    def busy(self, path: str) -> bool:
        thread = self._running.get(path)
        return thread is not None and thread.is_alive()

    def index_codebase(self, path: str, force: bool = False, splitter: str = "ast", customExtensions: list[str] | None = None, ignorePatterns: list[str] | None = None) -> str:  # noqa: N803
        path = self._path(path)
        if splitter not in split.KINDS:
            raise ValueError(f"unknown splitter {splitter!r}; known: {', '.join(split.KINDS)}.")
        with self._lock:
            if self.busy(path):
                return f"Error: {path!r} is being indexed already."
            if self.engine.has_index(path) and not force:
                return f"Error: {path!r} is indexed already. Use force=true to index it anew."
            if not self.engine.has_index(path) and not self.engine.store.within_limit():
                return f"Error: the limit of {self.engine.store.most} collections is reached. Clear an index first."
            self.engine.add_extensions(customExtensions or [])
            self.engine.add_ignore_patterns(ignorePatterns or [])

            def work() -> None:
                try:
                    self.engine.index(path, force, splitter, lambda _, percent: self._percent.__setitem__(path, percent))
                except Exception:  # the status table says what failed
                    pass

            self._running[path] = threading.Thread(target=work, name=f"index {path}", daemon=True)
            self._running[path].start()
        return f"Started indexing {path!r} with the {splitter} splitter. Searches see what is committed."

    def wait(self, path: str, seconds: float | None = None) -> None:
        if thread := self._running.get(os.path.abspath(path)):
            thread.join(seconds)

    def search_code(self, path: str, query: str, limit: int = values.TOOL_LIMIT, extensionFilter: list[str] | None = None) -> str:  # noqa: N803
        path = self._path(path)
        if not self.engine.has_index(path):
            return f"Error: {path!r} is not indexed. Index it first."
        found = self.engine.search_tool(path, query, limit, extensionFilter)
        shown = found.select(text_.location(F.col("relative_path"), F.col("start_line"), F.col("end_line")).alias("at"), "language", text_.truncated(F.col("content"), SHOWN_CHARS).alias("content")).collect()  # at most 50
        note = "\n\nIndexing goes on: results may be incomplete." if self.busy(path) else ""
        if not shown:
            return f"No results for {query!r} in {path!r}.{note}"
        parts = [f"{k}. {r['language']} [{os.path.basename(path)}]\n   {r['at']}\n   Rank: {k}\n```{r['language']}\n{r['content']}\n```" for k, r in enumerate(shown, 1)]
        return f"Found {len(shown)} results for {query!r} in {path!r}.\n\n" + "\n\n".join(parts) + note

    def clear_index(self, path: str) -> str:
        path = self._path(path)
        if self.busy(path):
            return f"Error: {path!r} is being indexed."
        if not self.engine.has_index(path):
            return f"Error: {path!r} is not indexed."
        self.engine.clear(path)
        return f"Cleared the index of {path!r}."

    def get_indexing_status(self, path: str) -> str:
        path = self._path(path)
        if self.busy(path):
            return f"{path!r} is being indexed: {self._percent.get(path, 0)}%."
        row = self.engine._status_table().filter(F.col("codebase_path") == path).first()
        if row is None:
            return f"{path!r} is not indexed."
        if row["status"] == "indexed":
            capped = " The limit on chunks was reached." if row["index_status"] == "limit_reached" else ""
            return f"{path!r} is indexed: {row['indexed_files']} files, {row['total_chunks']} chunks, at {row['last_updated']}.{capped}"
        return f"Indexing {path!r} failed: {row['error_message']}" if row["status"] == "indexfailed" else f"{path!r} is {row['status']}."
