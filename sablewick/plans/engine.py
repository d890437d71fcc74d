"""The engine: index a source tree, search it, keep it fresh.

``Engine`` holds configuration only; rows live in collections of a ``Store``.
A tree is scanned once per run: chunks and the recorded state come from the same
written scan, so an edit during a run is seen by the next one.  Chunks are
embedded and committed in several steps, so what is done can be searched while
the rest is on its way; the driver resolves configuration and commits versions.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sablewick.functions import ids, paths, values
from sablewick.functions.embed import Embedder, HashEmbedder
from sablewick.operators import ann
from sablewick.operators import search as search_
from sablewick.operators import split as split_
from sablewick.operators import sync as sync_
from sablewick.plans.filters import parse_filter
from sablewick.sources import codefiles, github
from sablewick.sources.state import FAILURES, STATE, STATUS, Versioned, status_of, upsert
from sablewick.sources.store import Store

RESULTS = "content string, relative_path string, start_line long, end_line long, language string, score double"


def setting(name: str, default: str | None = None, home: str | None = None) -> str | None:
    """An environment variable, else the same name in ``<home>/.env``, else the default."""
    if name in os.environ:
        return os.environ[name]
    path = os.path.join(home or os.path.expanduser("~/.context"), ".env")
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, found, value = line.strip().partition("=")
                if found and key == name:
                    return value
    return default


def save_setting(name: str, value: str, home: str | None = None) -> None:
    """Set a name in ``<home>/.env``, keeping the other lines."""
    home = home or os.path.expanduser("~/.context")
    os.makedirs(home, exist_ok=True)
    path = os.path.join(home, ".env")
    lines = open(path, encoding="utf-8").read().splitlines() if os.path.isfile(path) else []
    kept = [line for line in lines if line.partition("=")[0] != name]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*kept, f"{name}={value}"]) + "\n")


@dataclass
class Config:
    """Settings; environment variables and ``~/.context/.env`` fill in what isn't given."""

    hybrid: bool = field(default_factory=lambda: (setting("HYBRID_MODE", "true") or "").lower() == "true")
    extensions: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    chunk_cap: int = values.CHUNK_CAP
    commit_chunks: int = 50_000  # chunks of one commit while indexing
    on_error: str = "fail"  # or "skip": leave out chunks whose embedding fails; the next syncs try them again
    retry_minutes: float = 1.0  # before the first further try; doubled with each
    most_collections: int | None = None
    vector_index: bool = False  # build a vector index when a tree has been indexed; what syncs add is searched beside it
    home: str = field(default_factory=lambda: os.path.expanduser("~/.context"))

    def all_extensions(self) -> list[str]:
        return paths.merge_extensions(values.EXTENSIONS, self.extensions, paths.extensions_from_env(setting("CUSTOM_EXTENSIONS", home=self.home)))

    def all_ignored(self, root: str | None = None) -> list[str]:
        own = [p.strip() for p in (setting("CUSTOM_IGNORE_PATTERNS", "", self.home) or "").split(",") if p.strip()]
        found = codefiles.root_ignore_patterns(root) if root and os.path.isdir(root) else []
        everywhere = os.path.join(self.home, ".contextignore")
        if os.path.isfile(everywhere):
            with open(everywhere, encoding="utf-8", errors="replace") as f:
                found += paths.parse_ignore_file(f.read())
        return paths.merge_patterns(values.IGNORE_PATTERNS, self.ignore, own, found)


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, splitter: split_.Splitter | None = None, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.embedder, self.splitter = embedder or HashEmbedder(), splitter or split_.Splitter()
        self.root, self.store = root.rstrip("/"), Store(spark, f"{root}/collections", most=self.config.most_collections)
        self.trees, self.failures = Versioned(spark, f"{root}/trees", sync_.NODES), Versioned(spark, f"{root}/failures", FAILURES)
        self.states, self.statuses = Versioned(spark, f"{root}/states", STATE), Versioned(spark, f"{root}/status", STATUS)

    # ------------------------------------------------------------ configuration

    def update_embedder(self, embedder: Embedder) -> None:
        self.embedder = embedder

    def update_splitter(self, splitter: split_.Splitter) -> None:
        self.splitter = splitter

    def update_store(self, store: Store) -> None:
        self.store = store

    def update_ignore_patterns(self, patterns: Iterable[str]) -> None:
        self.config.ignore = list(patterns)

    def add_ignore_patterns(self, patterns: Iterable[str]) -> None:
        self.config.ignore = paths.merge_patterns(self.config.ignore, patterns)

    def reset_ignore_patterns(self) -> None:
        self.config.ignore = []

    def add_extensions(self, extensions: Iterable[str]) -> None:
        self.config.extensions = paths.merge_extensions(self.config.extensions, extensions)

    def ignore_patterns(self, path: str | None = None) -> list[str]:
        return self.config.all_ignored(path)

    def splitter_info(self) -> dict:
        return self.splitter.info()

    def is_language_supported(self, language: str) -> bool:
        return self.splitter.kind != "ast" or split_.syntax_language(language) is not None

    def collection_name(self, path: str) -> str:
        return self.spark.range(1).select(ids.collection_name(F.lit(os.path.abspath(path)), self.config.hybrid).alias("n")).first()["n"]

    def _key(self, path: str) -> str:
        return self.spark.range(1).select(ids.snapshot_key(F.lit(os.path.abspath(path))).alias("k")).first()["k"]

    # ------------------------------------------------------------ plans

    def tree(self, path: str) -> DataFrame:
        """All files of a tree that should be indexed; content is null, and error says why, where one can't be read."""
        patterns = self.ignore_patterns(path)
        rows = codefiles.read_tree(self.spark, path, extensions=",".join(self.config.all_extensions()), ignore=",".join(patterns))
        return rows.withColumn("language", paths.language(F.col("relative_path")))

    def files(self, path: str) -> DataFrame:
        """The files of a tree that are indexed: relative_path, content, file_extension, language."""
        return self.tree(path).filter("content IS NOT NULL")

    def chunks(self, files: DataFrame, codebase: str, splitter: split_.Splitter | None = None) -> DataFrame:
        """Chunks with ids and metadata, before embedding."""
        pieces = (splitter or self.splitter).chunks(files)
        metadata = F.to_json(F.struct(F.lit(codebase).alias("codebasePath"), F.col("language"), F.col("pos").alias("chunkIndex")))
        return pieces.select(
            ids.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("id"),
            "content", "relative_path", "pos", "start_line", "end_line", paths.extension(F.col("relative_path")).alias("file_extension"), metadata.alias("metadata"),
        )

    def embedded(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("vector", self.embedder.column(self.config.on_error)(F.col("content")))

    @contextmanager
    def tried(self, chunks: DataFrame):
        """Chunks with vectors, and (relative_path, id) of those whose embedding failed and may be left out."""
        rows = self.embedded(chunks)
        if self.config.on_error != "skip":
            yield rows, None
            return
        with self.written(rows) as done:  # each chunk is sent to the provider once
            yield done.filter("vector IS NOT NULL"), done.filter("vector IS NULL").select("relative_path", "id")

    # ------------------------------------------------------------ failures

    def failed(self, path: str) -> DataFrame:
        """The ledger: chunks (or, with a null id, files) that are still missing, how often they were tried, and when they are tried next."""
        found = self.failures.load(self._key(os.path.abspath(path)))
        return found if found is not None else self.spark.createDataFrame([], FAILURES)

    def _note(self, key: str, missing: DataFrame | None, kept: DataFrame | None) -> None:
        """Save the ledger: what failed now (relative_path, id, error), with one more try than ``kept`` has of it, and the rest of ``kept``."""
        old = self.spark.createDataFrame([], FAILURES) if kept is None else kept
        now = self.spark.createDataFrame([], "relative_path string, id string, error string") if missing is None else missing
        tries = old.select(F.col("relative_path").alias("p"), F.col("id").alias("i"), "attempts")
        both = now.join(tries, F.col("relative_path").eqNullSafe(F.col("p")) & F.col("id").eqNullSafe(F.col("i")), "left")
        attempts = F.coalesce("attempts", F.lit(0)) + 1
        wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(60.0 * self.config.retry_minutes) * F.pow(F.lit(2.0), F.least(attempts, F.lit(20)) - 1))
        rows = both.select("relative_path", "id", attempts.cast("int").alias("attempts"), "error", (F.current_timestamp() + wait).alias("retry_at"))
        rest = old.join(now.select(F.col("relative_path").alias("p"), F.col("id").alias("i")), F.col("relative_path").eqNullSafe(F.col("p")) & F.col("id").eqNullSafe(F.col("i")), "left_anti")
        self.failures.save(key, rows.unionByName(rest))

    @contextmanager
    def written(self, rows: DataFrame):
        """The rows as a table of their own for the time of a run."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        try:
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self.store.files.delete(path)

    def scan(self, path: str):
        """One scan of a tree, with every file's hash (null where a file can't be read)."""
        return self.written(self.tree(path).withColumn("hash", ids.file_hash(F.col("content"))))

    def _record(self, key: str, state: DataFrame) -> None:
        self.states.save(key, state)
        self.trees.save(key, sync_.directory_nodes(self.states.load(key)))

    def file_hash(self, path: str, relative_path: str) -> str | None:
        """The hash recorded for one file of an indexed tree."""
        state = self.states.load(self._key(os.path.abspath(path)))
        row = state.filter(F.col("relative_path") == relative_path).select("hash").first() if state is not None else None
        return row["hash"] if row else None

    # ------------------------------------------------------------ index

    def index(self, path: str, force: bool = False, splitter: str | None = None, progress: Callable[[str, int], None] | None = None) -> dict:
        """Index a tree: {indexed_files, total_chunks, status}."""
        path, tell = os.path.abspath(path), progress or (lambda phase, percent: None)
        if not os.path.isdir(path):
            raise NotADirectoryError(path)
        name = self.collection_name(path)
        if self.store.has(name):
            if not force:
                raise ValueError(f"{path} is indexed already; use force to index it anew")
            self.clear(path)
        try:
            tell("Preparing", 0)
            self.set_status(path, "indexing", indexing_percentage=0.0)
            self.store.create(name, self.embedder.dimension, self.config.hybrid, path)
            tell("Scanning", 5)
            chosen = split_.Splitter(splitter) if splitter else self.splitter
            with self.scan(path) as scanned, self.written(self.chunks(scanned.filter("content IS NOT NULL"), path, chosen)) as every:
                files, unread = scanned.filter("content IS NOT NULL"), scanned.filter("content IS NULL")
                missing = unread.select("relative_path", F.lit(None).cast("string").alias("id"), "error")
                chunks, outcome = split_.capped(every, self.config.chunk_cap)
                steps = max(1, -(-min(every.count(), self.config.chunk_cap) // self.config.commit_chunks))
                for k in range(steps):
                    percent = 10 + 90 * k // steps
                    tell("Indexing", percent)
                    self.set_status(path, "indexing", indexing_percentage=float(percent))
                    mine = chunks if steps == 1 else chunks.filter(F.pmod(F.xxhash64("relative_path"), F.lit(steps)) == k)
                    with self.tried(mine) as (ready, lost):
                        self.store.insert(name, ready)
                        if lost is not None and not lost.isEmpty():
                            self._note(self._key(path), lost.withColumn("error", F.lit("embedding failed")), self.failed(path))
                if not missing.isEmpty():
                    self._note(self._key(path), missing, self.failed(path))
                if self.config.vector_index:
                    ann.index_collection(self.store, name)
                self._record(self._key(path), files.select("relative_path", "hash"))  # after the chunks: a failure before is tried again
                if not self.store.ready(name, wait=60.0):
                    raise TimeoutError(f"collection {name!r} can't be read")
                n_files, n_chunks = files.count(), self.store.count(name)
        except Exception as failed:
            reached = self._status_table().filter(F.col("codebase_path") == path).select("indexing_percentage").first()
            self.set_status(path, "indexfailed", error_message=str(failed)[:2000], last_attempted_percentage=reached[0] if reached else None)
            raise
        self.set_status(path, "indexed", indexed_files=n_files, total_chunks=n_chunks, index_status=outcome, indexing_percentage=100.0)
        tell("Done", 100)
        return {"indexed_files": n_files, "total_chunks": n_chunks, "status": outcome}

    def index_repo(self, get, owner: str, repo: str) -> dict:
        """Index a hosted repository's default branch; ``get`` fetches parsed JSON by path."""
        name = self.spark.range(1).select(ids.repo_collection(F.lit(f"{owner}/{repo}")).alias("n")).first()["n"]
        self.store.drop(name)
        self.store.create(name, self.embedder.dimension, self.config.hybrid, f"{owner}/{repo}")
        files = github.repo_contents(github.repo_files(self.spark, get, owner, repo), get, owner, repo)
        files = files.filter("content IS NOT NULL").withColumn("language", paths.language(F.col("relative_path")))
        chunks = self.chunks(files, f"{owner}/{repo}", split_.Splitter("lines")).withColumn("id", ids.repo_chunk_id(F.col("relative_path"), F.col("pos")))
        with self.tried(chunks) as (ready, _):
            self.store.insert(name, ready)
        return {"collection": name, "total_chunks": self.store.count(name)}

    def search_collection(self, name: str, query: str, k: int = 20, filter_expr: str | None = None) -> DataFrame:
        """Search one collection by its name."""
        if not self.store.has(name):
            return self.spark.createDataFrame([], RESULTS)
        return self._found(name, query, k, filter_expr)

    def _found(self, name: str, query: str, k: int, filter_expr: str | None, threshold: float | None = None, rerank: str = "rrf") -> DataFrame:
        docs, where, vector = self.store.read(name), parse_filter(filter_expr), self.embedder.embed(query)
        if self.config.hybrid:
            top = search_.hybrid(docs, query, vector, k, where=where, rerank=rerank, index=self.full_text(name), dense=ann.dense_stored(self.store, name, vector, k, where=where))
        else:
            top = ann.dense_stored(self.store, name, vector, k, where=where, threshold=threshold).select("id", "score")
        return search_.as_results(top, docs.withColumn("language", F.get_json_object("metadata", "$.language")))

    def full_text(self, name: str) -> tuple[DataFrame, tuple[int, int], DataFrame | None] | None:
        """A collection's blocks of postings, totals and deleted rows; None where it keeps no full-text index."""
        return (self.store.blocks(name), self.store.totals(name), self.store.gone(name)) if self.store.describe(name)["hybrid"] else None

    def sync(self, path: str) -> dict:
        """Bring the index up to date: {added, removed, modified}.

        Only directories whose digests differ are compared.  A file that can't be read
        keeps what is indexed of it.  Chunks and files that failed before are tried
        again once their time has come.
        """
        path = os.path.abspath(path)
        name, key = self.collection_name(path), self._key(path)
        with self.scan(path) as scanned:
            old, files = self.states.load(key), scanned.filter("content IS NOT NULL")
            new = files.select("relative_path", "hash")
            if old is None:
                self._record(key, new)
                return {"added": 0, "removed": 0, "modified": 0}
            unread = scanned.filter("content IS NULL").select("relative_path", F.lit(None).cast("string").alias("id"), "error")
            new = new.unionByName(old.join(unread, "relative_path", "left_semi").select("relative_path", "hash"))
            with self.written(sync_.directory_nodes(new)) as nodes:
                before = self.trees.load(key)
                diff = sync_.snapshot_diff(old, new) if before is None else sync_.tree_diff(old, new, before, nodes)
                with self.written(diff) as diff:
                    counts = {"added": 0, "removed": 0, "modified": 0} | {r["change"]: r["n"] for r in sync_.diff_counts(diff).collect()}  # three rows at most
                    self._apply(path, name, key, files, unread, new, diff, any(counts.values()))
        return counts

    def _apply(self, path: str, name: str, key: str, files: DataFrame, unread: DataFrame, new: DataFrame, diff: DataFrame, changed: bool) -> None:
        ledger = self.failed(path)
        due = ledger.filter("id IS NOT NULL AND retry_at <= current_timestamp()").join(diff, "relative_path", "left_anti")
        if not changed and due.isEmpty() and unread.isEmpty() and ledger.filter("id IS NULL").isEmpty():
            return
        fresh = diff.filter(F.col("change") != "removed").select("relative_path")
        chunks = self.chunks(files.join(fresh, "relative_path", "left_semi"), path)
        again = self.chunks(files.join(due.select("relative_path").distinct(), "relative_path", "left_semi"), path).join(due.select("id"), "id", "left_semi")
        with self.tried(chunks.unionByName(again)) as (ready, lost):
            stale = diff.filter(F.col("change") != "added").select("relative_path")
            self.store.change(name, "relative_path", stale, ready)
            missing = unread if lost is None else unread.unionByName(lost.withColumn("error", F.lit("embedding failed")))
            # Entries of changed files and of what was tried are over, unless it failed again.
            waiting = ledger.join(diff, "relative_path", "left_anti").filter("id IS NOT NULL").join(due.select("id"), "id", "left_anti")
            tried = ledger.join(missing.select(F.col("relative_path").alias("p"), F.col("id").alias("i")), F.col("relative_path").eqNullSafe(F.col("p")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
            with self.written(waiting.select(*ledger.columns).unionByName(tried).distinct()) as kept:
                self._note(key, missing, kept)
        if changed:
            self._record(key, new)
            self.store.compact(name)

    def sync_all(self, paths_: Iterable[str] | None = None) -> dict[str, dict | str]:
        """``sync`` for every indexed tree (or those given); one that fails is told with its error, which its status keeps until a sync succeeds, and the others go on."""
        if paths_ is None:
            paths_ = [r["codebase_path"] for r in self._status_table().filter("status = 'indexed'").select("codebase_path").collect()]  # one row per indexed tree
        out: dict[str, dict | str] = {}
        for path in sorted(paths_):
            try:
                if not os.path.isdir(path):
                    raise NotADirectoryError(path)
                out[path] = self.sync(path)
                self._note_error(path, None)
            except Exception as failed:
                out[path] = f"{type(failed).__name__}: {failed}"[:2000]
                self._note_error(path, out[path])
        return out

    def poll(self, checkpoint: str, minutes: float = 5, told: Callable[[dict], None] | None = None) -> StreamingQuery:
        """Keep all indexed trees fresh in the background: ``sync_all`` every ``minutes``, one run at a time."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def run(_: DataFrame, __: int) -> None:
            done = self.sync_all()
            if told:
                told(done)

        return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, int(minutes * 60))} seconds").start()

    def clear(self, path: str) -> None:
        path = os.path.abspath(path)
        self.store.drop(self.collection_name(path))
        for kept in (self.states, self.trees, self.failures):
            kept.delete(self._key(path))
        self.remove_status(path)

    def test_connection(self) -> bool:
        """Whether collections can be written and read, and the embedder answers."""
        try:
            self.store.check()
            return len(self.embedder.embed("test")) == self.embedder.dimension
        except Exception:
            return False

    def has_index(self, path: str) -> bool:
        return self.store.has(self.collection_name(path))

    # ------------------------------------------------------------ search

    def search(self, path: str, query: str, k: int = 5, threshold: float = 0.0, filter_expr: str | None = None, rerank: str = "rrf") -> DataFrame:
        """The public result columns of the ``k`` best chunks; empty if the tree isn't indexed.

        ``threshold`` holds for dense search; fused scores are not similarities.
        """
        name = self.collection_name(path)
        if not self.store.has(name):
            return self.spark.createDataFrame([], RESULTS)
        return self._found(name, query, k, filter_expr, threshold, rerank)

    def search_tool(self, path: str, query: str, limit: int = values.TOOL_LIMIT, extension_filter: list[str] | None = None) -> DataFrame:
        """Search as the tool offers it: at most 50 rows, optionally of some extensions."""
        listed = paths.check_extension_filter(extension_filter or [])
        expr = f"fileExtension in [{', '.join(repr(e) for e in listed)}]" if listed else None
        return self.search(path, query, min(limit, values.TOOL_MOST), 0.3, expr)

    # ------------------------------------------------------------ status

    def _status_table(self) -> DataFrame:
        found = self.statuses.load("status")
        return found if found is not None else self.spark.createDataFrame([], STATUS)

    def set_status(self, path: str, status: str, **columns) -> None:
        row = self.spark.createDataFrame([{"codebase_path": path, "status": status, **columns}], STATUS).withColumn("last_updated", F.current_timestamp())
        self.statuses.save("status", upsert(self._status_table(), row, "codebase_path"))

    def _note_error(self, path: str, message: str | None) -> None:
        """Put a failed sync into the tree's status, or take it out; nothing is written if nothing changes."""
        row = self._status_table().filter(F.col("codebase_path") == path).select("error_message").first()
        if row is not None and row["error_message"] != message:
            told = F.when(F.col("codebase_path") == path, F.lit(message)).otherwise(F.col("error_message"))
            self.statuses.save("status", self._status_table().withColumn("error_message", told))

    def remove_status(self, path: str) -> None:
        self.statuses.save("status", self._status_table().filter(F.col("codebase_path") != path))

    def status(self, path: str) -> str:
        return status_of(self._status_table(), os.path.abspath(path))

    def reconcile(self) -> list[str]:
        """Forget the status of trees whose collection is gone; returns what was forgotten."""
        rows = self._status_table().filter("status = 'indexed'").select("codebase_path").collect()  # one row per indexed tree
        gone = [r["codebase_path"] for r in rows if not self.store.has(self.collection_name(r["codebase_path"]))]
        for path in gone:
            self.remove_status(path)
        return gone
