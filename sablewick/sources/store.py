"""Collections of chunks on a file system that Spark writes.

A collection is a folder of immutable parts and a pointer to what is current.  A
change writes what is new and then moves the pointer, so a reader sees the last
committed state, a failed write leaves nothing visible, and no folder is
overwritten while it is read.

Reads merge: deleting rows writes their ids and the part they are in (a deletion
vector), and what reads that part leaves them out.  So a change costs what it
changes.  ``compact`` rewrites parts that are mostly deleted, and small ones once
there are many.  What a commit no longer needs is deleted by a later one, after
``retention`` seconds in which readers may still be at it.

A part is sorted by id within its files and has Bloom filters for ids and paths,
so a few rows are fetched by reading the row groups that may hold them.

A hybrid collection also has a full-text index beside each of its parts: for each
term blocks of postings (id, tf, dl) with the largest tf and the smallest dl in
them.  All blocks of a part that hold the same rows have the same ``span``; rows
of about equal length share one.  A shelf is a folder that holds all blocks of a
stretch of one of the part's files, sorted by term: a search reads the pages of its
own terms on each shelf, and of those only blocks that can matter.  So an index is
made where the texts lie, and neither they nor their postings are exchanged; a
deletion vector tells the files of its rows, and so their shelves.  Only where an id
is there twice, rows are dealt by id first, so that it lies in one file.  How many
rows and terms a part holds stands in the pointer.

One writer at a time: a change that finds another one committed since it began
raises ``Conflict`` and leaves the collection as that one made it.  That holds on
local disks and where a rename without overwriting is atomic, as on HDFS; on an
object store without that, writers have to be kept apart by other means.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewick.functions import text as text_
from sablewick.functions import values

CHUNK_SCHEMA = "id string, vector array<float>, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string"
PART_SCHEMA = f"{CHUNK_SCHEMA}, n_terms long"
GONE_SCHEMA = "part string, id string"
LENGTHS = {"id": 512, "content": 65535, "relative_path": 1024, "file_extension": 32, "metadata": 65535}

BLOCK_SCHEMA = "term string, span long, n long, max_tf long, min_dl long, rows array<struct<id:string,tf:long,dl:long>>"
POSTINGS_SCHEMA = "term string, id string, tf long, dl long"
#: Rows that share a span of postings, about; deleted rows that are sent to every task, at most.
SPAN_ROWS, SENT_ROWS = 128, 100_000
#: Characters of the texts of one shelf of a full-text index, about; numbers kept for the shelves of one file.
SHELF_CHARS, FILE_SHELVES = 16_000_000, 1_000_000
#: Bytes of a part's files, which are packed, that one task reads to make shelves.
SPLIT_BYTES = 8_000_000
#: Words whose blocks go from Python to Spark at once, about.
BLOCK_BATCH = 20_000
#: Parts are rewritten when this share of their rows is deleted, or when there are more than so many.
GONE_SHARE, MOST_PARTS = 0.3, 32
#: Values of one pushed-down list; Spark tests longer ones by their range only.
PUSHED = 10


def _file() -> Column:
    """The number of the file in its part that a row stands in."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows (file, id, dl, words) in stretches of about ``most`` characters, each of one file; equal ids that follow each other stay together."""
    held, size, last = [], 0, None
    for batch in batches:
        begin = 0
        for k, (file, name, chars) in enumerate(zip(batch["file"].to_pylist(), batch["id"].to_pylist(), pc.binary_length(batch["words"]).to_pylist())):
            if last is not None and (file != last[0] or size >= most and name != last[1]):
                yield [*held, batch.slice(begin, k - begin)]
                held, size, begin = [], 0, k
            last, size = (file, name), size + chars
        held.append(batch.slice(begin))
    if last is not None:
        yield held


def _shelved(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of a task's rows (file, id, dl, words), stretch by stretch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, made = TaskContext.get().partitionId() << 32, defaultdict(int)  # of a file's stretches, so many so far
        for held in _stretches(batches, most):
            rows = pa.Table.from_batches(held)
            file, name, dl = rows["file"][0].as_py(), rows["id"].to_numpy(), rows["dl"].to_numpy()
            slots = max(1, len(rows) // (8 * SPAN_ROWS))  # of each length, which a stretch has about eight common ones of
            row = np.cumsum(np.append(0, name[1:] != name[:-1]))
            span = np.unique(np.floor(4 * np.log2(dl + 1)).astype(np.int64) * slots + row % slots, return_inverse=True)[1]
            shelf = np.full(len(rows), file * FILE_SHELVES + made[file])
            yield from _blocks(iter(rows.append_column("shelf", pa.array(shelf)).append_column("span", pa.array(spans + span)).to_batches()))
            spans, made[file] = spans + int(span.max()) + 1, made[file] + 1

    return work


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one shelf from its rows (shelf, span, id, dl, words), by term and span, those of a few terms at a time."""
    rows = pa.Table.from_batches(batches).sort_by([("span", "ascending"), ("id", "ascending")]).combine_chunks()
    size, shelf, span, dl, name = len(rows), rows["shelf"][0].as_py(), rows["span"].to_numpy(), rows["dl"].to_numpy(), rows["id"].combine_chunks()
    words = pc.split_pattern(rows["words"].combine_chunks(), " ")
    same = np.append(False, (span[1:] == span[:-1]) & (name[1:].to_numpy(zero_copy_only=False) == name[:-1].to_numpy(zero_copy_only=False)))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(size)))  # an id that is there twice counts as one row
    times, coded = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
    del rows, words
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, terms = rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))
    del coded
    key *= size
    key += np.repeat(first, times)
    key.sort()
    begin = 0
    while begin < len(key):
        last = key[min(begin + BLOCK_BATCH, len(key)) - 1] // size
        end = int(np.searchsorted(key, (last + 1) * size))  # a term's postings stay together
        part = key[begin:end]
        at = np.flatnonzero(np.diff(part, prepend=-1))  # where a posting begins
        tf = np.diff(at, append=len(part))
        term, row = np.divmod(part[at], size)
        head = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(span[row], prepend=-1) != 0))  # where a block begins
        held = pa.StructArray.from_arrays([name.take(pa.array(row)), pa.array(tf), pa.array(dl[row])], names=["id", "tf", "dl"])
        blocks = {
            "shelf": np.full(len(head), shelf), "term": terms.take(pa.array(term[head])), "span": span[row[head]], "n": np.diff(head, append=len(at)),
            "max_tf": np.maximum.reduceat(tf, head), "min_dl": np.minimum.reduceat(dl[row], head), "rows": pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), held),
        }
        yield pa.RecordBatch.from_pydict(blocks)
        begin = end


class Conflict(RuntimeError):
    """Another writer committed in between."""


class LimitReached(RuntimeError):
    """No further collection is allowed."""


def any_of(column: str, wanted: list) -> Column:
    """``column`` is one of few values, in lists short enough to be tested against Bloom filters and statistics."""
    found = F.lit(False)
    for k in range(0, len(wanted), PUSHED):
        found = found | F.col(column).isin(wanted[k : k + PUSHED])
    return found


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share.

    It lies below ``spark.checkpoint.dir``; where that is unset, on one machine
    only, below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/sablewick-{spark.sparkContext.applicationId}"


class Files:
    """The few operations needed, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def tree(self, name: str) -> list[tuple[str, int, int]]:
        """(path, bytes, time) of all files below, or of the file itself."""
        found, out = self.fs.listFiles(self.path(name), True), []
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def write(self, name: str, text: str) -> None:
        """Write beside a name that is not there yet, then move into place in one step that fails if it is."""
        beside = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._place(beside, name)
        except Py4JJavaError as failed:
            self.delete(beside)
            raise Conflict(f"{name} is there already") from failed

    def _place(self, beside: str, name: str) -> None:
        if self.fs.getUri().getScheme() == "file":  # a hard link, since a rename would replace
            plain = [self.jvm.java.nio.file.Paths.get(self.path(n).toUri().getPath(), self.gateway.new_array(self.jvm.java.lang.String, 0)) for n in (name, beside)]
            self.jvm.java.nio.file.Files.createLink(*plain)
            self.delete(beside)
        else:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            context.rename(self.path(beside), self.path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Pointer:
    """What is current, as numbered files of which the highest holds.

    A change adds the next number in one step, so a reader finds the old or the
    new one and never none, and of two writers that began alike one fails.  The
    file before stays, for a reader that has just listed the folder.
    """

    def __init__(self, files: Files, folder: str, name: str):
        self.files, self.folder, self.name = files, folder, name

    def _numbers(self) -> list[int]:
        head, tail = f"{self.name}.", ".json"
        found = (n[len(head) : -len(tail)] for n in self.files.names(self.folder) if n.startswith(head) and n.endswith(tail))
        return sorted(int(n) for n in found if n.isdigit())

    def _at(self, number: int) -> str:
        return f"{self.folder}/{self.name}.{number:012d}.json"

    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self) -> tuple[int, dict] | None:
        """Number and content, or None."""
        for last in (False, False, False, True):
            numbers = self._numbers()
            if not numbers:
                return None
            try:
                return numbers[-1], json.loads(self.files.read(self._at(numbers[-1])))
            except Py4JJavaError:  # two changes since it was listed, or the whole is being deleted
                if last:
                    raise
        return None

    def move(self, after: int, content: dict) -> None:
        """Make ``content`` current, if ``after`` (0: nothing) still is."""
        if (self._numbers() or [0])[-1] != after:
            raise Conflict(f"{self.folder}/{self.name} was changed by another writer")
        self.files.write(self._at(after + 1), json.dumps(content))
        for number in self._numbers():
            if number < after:
                self.files.delete(self._at(number))

    def delete(self) -> None:
        for number in self._numbers():
            self.files.delete(self._at(number))


class Store:
    """Named collections below one root folder."""

    def __init__(self, spark: SparkSession, root: str, limits: dict[str, int] | None = None, retention: float = 3600.0, most: int | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.limits, self.retention, self.most = LENGTHS if limits is None else limits, retention, most

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _pointer(self, name: str) -> Pointer:
        return Pointer(self.files, self._at(name), "current")

    def _current(self, name: str) -> tuple[int, dict]:
        found = self._pointer(name).read()
        if found is None:
            raise KeyError(f"no collection {name!r}")
        return found

    def describe(self, name: str) -> dict:
        return self._current(name)[1]

    # ------------------------------------------------------------ collections

    def create(self, name: str, dimension: int, hybrid: bool = True, description: str = "") -> None:
        if self.has(name):
            raise ValueError(f"collection {name!r} exists")
        if not self.within_limit():
            raise LimitReached(f"the limit of {self.most} collections is reached: clear one first")
        self._pointer(name).move(0, {"name": name, "dimension": dimension, "hybrid": hybrid, "description": description, "version": None, "parts": {}, "gone": {}, "retired": {}, "at": time.time()})

    def has(self, name: str) -> bool:
        return self._pointer(name).exists()

    def list(self, prefix: str = "") -> list[str]:
        """Names of collections, by default of all."""
        return [n for n in self.files.names(self.root) if n.startswith(prefix) and self.has(n)]

    def drop(self, name: str) -> None:
        self.files.delete(self._at(name))

    def clear(self, name: str) -> None:
        """Drop all rows, keep the collection."""
        at, about = self._current(name)
        self._commit(name, at, about, {}, {})

    def within_limit(self, most: int | None = None) -> bool:
        """Whether one more collection is allowed: by ``most``, or else by the store's own limit."""
        most = self.most if most is None else most
        return most is None or len(self.list()) < most

    def ready(self, name: str, wait: float = 0.0, pause: float = 0.5, longest: float = 5.0) -> bool:
        """Whether the collection and all of its parts can be read, asked again after growing pauses for up to ``wait`` seconds."""
        until = time.time() + wait
        while True:
            if self.has(name) and all(self.files.exists(f"{self._at(name)}/{p}") for p in self.describe(name)["parts"]):
                return True
            left = until - time.time()
            if left <= 0:
                return False
            time.sleep(min(pause, left))
            pause = min(1.5 * pause, longest)

    def check(self) -> None:
        """Write, read and delete a small file: raises where the root can't be used."""
        probe = f"{self.root}/.probe-{uuid.uuid4().hex}"
        self.files.write(probe, "ok")
        try:
            if self.files.read(probe) != "ok":
                raise OSError(f"{self.root} does not keep what is written")
        finally:
            self.files.delete(probe)

    # ------------------------------------------------------------ reading

    def _paths(self, name: str, parts, kind: str = "") -> list[str]:
        return [f"{self._at(name)}/{kind}{p}" for p in parts]

    def _live(self, name: str, about: dict, schema: str, kind: str = "", where: Column | None = None, rows=None) -> DataFrame:
        """Rows of all parts but deleted ones, with ``part`` and ``file``; ``rows`` turns what is stored into rows with an id."""
        reader, empty = self.spark.read.schema(schema).option("recursiveFileLookup", "true"), self.spark.createDataFrame([], f"{schema}, part string, file long")
        dirty = sorted({p for g in about["gone"].values() for p in g} & about["parts"].keys())
        clean = [p for p in about["parts"] if p not in dirty]
        part = F.regexp_extract(F.col("_metadata.file_path"), "part-[0-9a-f]+", 0)

        def stored(parts: list[str], below: list[str] | None = None) -> DataFrame:
            at = self._paths(name, parts, kind) if below is None else below
            found = reader.parquet(*at).withColumns({"part": part, "file": _file()}) if at else empty
            found = found if where is None else found.filter(where)
            return rows(found) if rows else found

        if not dirty:
            return stored(clean)
        gone, kept = self._gone(name, about), [stored(clean)] if clean else []
        shelved = [] if self._few(about) or kind != "terms-" else [p for p in dirty if p in about.get("shelved", [])]
        for below, lost, shares in self._runs(name, about, shelved):
            for k in range(shares):
                mine = F.pmod(F.xxhash64("id"), F.lit(shares)) == k
                kept.append(stored([], below).filter(mine).join(F.broadcast(lost.filter(mine).select("id")), "id", "left_anti"))
        whole = [p for p in dirty if p not in shelved]
        if whole:
            kept.append(stored(whole).join(gone, ["part", "id"], "left_anti"))
        return reduce(DataFrame.unionByName, kept)

    def _runs(self, name: str, about: dict, parts: list[str]) -> Iterator[tuple[list[str], DataFrame, int]]:
        """(folders, deleted rows, shares): the shelves of these parts in runs from which so few rows are deleted that these can be sent, in as many shares where one file alone has lost more."""
        if not parts:
            return
        gone = self._gone(name, about, f"{GONE_SCHEMA}, file long").filter(F.col("part").isin(parts))
        lost = {(r["part"], r["file"]): r["count"] for r in gone.groupBy("part", "file").count().collect()}  # one row for each file
        for p in parts:
            there = defaultdict(list)
            for folder in self.files.names(f"{self._at(name)}/terms-{p}"):
                if folder.startswith("shelf="):
                    there[int(folder.partition("=")[2]) // FILE_SHELVES].append(f"{self._at(name)}/terms-{p}/{folder}")
            runs, n = [], 0
            for file in sorted(there):
                more = lost.get((p, file), 0)
                if not runs or n + more > SENT_ROWS:
                    runs.append([])
                    n = 0
                runs[-1].append(file)
                n += more
            for files in runs:
                n = sum(lost.get((p, file), 0) for file in files)
                yield [f for file in files for f in there[file]], gone.filter((F.col("part") == p) & F.col("file").between(files[0], files[-1])), max(1, -(-n // SENT_ROWS))

    def _few(self, about: dict) -> bool:
        """Whether all deleted rows can be sent to every task."""
        return sum(n for g in about["gone"].values() for n, _ in g.values()) <= SENT_ROWS

    def _gone(self, name: str, about: dict, schema: str = GONE_SCHEMA) -> DataFrame:
        gone = self.spark.read.schema(schema).parquet(*self._paths(name, about["gone"]))
        return F.broadcast(gone) if self._few(about) else gone

    def _of(self, name: str, parts: list[str] | None) -> dict:
        about = self.describe(name)
        return about if parts is None else about | {"parts": {p: n for p, n in about["parts"].items() if p in parts}}

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """The rows, by default of all parts."""
        return self._live(name, self._of(name, parts), PART_SCHEMA).drop("part", "file", "n_terms")

    def fetch(self, name: str, wanted: list[str], parts: list[str] | None = None) -> DataFrame:
        """The rows with these ids (few), by reading the row groups that may hold them."""
        return self._live(name, self._of(name, parts), PART_SCHEMA, where=any_of("id", wanted)).drop("part", "file", "n_terms")

    def query(self, name: str, where=None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Filtered rows by id; without a filter at most the query cap."""
        rows = self.read(name)
        rows = rows if where is None else rows.filter(where)
        rows = rows.select(*columns) if columns else rows
        most = limit if limit is not None else values.QUERY_CAP if where is None else None
        return rows if most is None else (rows.orderBy("id") if "id" in rows.columns else rows).limit(most)

    def blocks(self, name: str) -> DataFrame:
        """The full-text index as it is stored: blocks of postings with their bounds, deleted rows included."""
        about = self.describe(name)
        if not about["hybrid"]:
            raise ValueError(f"collection {name!r} has no full-text index")
        return self._live(name, about | {"gone": {}}, BLOCK_SCHEMA, "terms-").drop("file")

    def gone(self, name: str) -> DataFrame | None:
        """(part, id) of deleted rows that parts still hold; None if there are none."""
        about = self.describe(name)
        return self._gone(name, about) if about["gone"] else None

    def postings(self, name: str) -> DataFrame:
        """The full-text index: term, id, tf, and dl (the number of terms of that row)."""
        about = self.describe(name)
        if not about["hybrid"]:
            raise ValueError(f"collection {name!r} has no full-text index")
        single = lambda blocks: blocks.select("term", "part", F.inline("rows"))
        return self._live(name, about, BLOCK_SCHEMA, "terms-", rows=single).select("term", "id", "tf", "dl")

    def totals(self, name: str) -> tuple[int, int]:
        """Rows and terms of the collection, from its pointer."""
        about = self.describe(name)
        held = list(about["parts"].values())
        gone = [g[p] for g in about["gone"].values() for p in g if p in about["parts"]]
        return tuple(sum(x[k] for x in held) - sum(x[k] for x in gone) for k in (0, 1))

    def count(self, name: str) -> int:
        return self.totals(name)[0]

    # ------------------------------------------------------------ writing

    def validated(self, rows: DataFrame, dimension: int) -> DataFrame:
        """The collection's columns; rows that break a limit raise when they are written."""
        bad = F.lit(False)
        for column, most in self.limits.items():
            bad = bad | (F.length(column) > most)
        bad = bad | (F.size("vector") != dimension)
        checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("row breaks a limit of its collection: "), F.col("id")))).otherwise(F.col("id"))
        cols = [f.split(" ")[0] for f in CHUNK_SCHEMA.split(", ")]
        return rows.withColumn("id", checked).select(*cols)

    def _written(self, name: str, about: dict, rows: DataFrame) -> dict[str, list[int]]:
        """A new part with its full-text index, and its numbers of rows and terms; nothing for no rows."""
        part, toks = f"part-{uuid.uuid4().hex}", text_.tokens(F.coalesce("content", F.lit("")))
        ready = self.validated(rows, about["dimension"]).withColumn("n_terms", F.size(toks).cast("long") if about["hybrid"] else F.lit(0).cast("long"))
        stored = self._stored(name, part, ready)
        n, terms, once = stored.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count_distinct("id") if about["hybrid"] else F.count("*")).first()
        if once < n:  # postings of one id become one: its rows have to lie together
            first, part = part, f"part-{uuid.uuid4().hex}"
            chars = stored.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
            stored = self._stored(name, part, stored.repartition(1 + chars // SHELF_CHARS, "id"), 1 << 30)  # one row group a file
            self.files.delete(f"{self._at(name)}/{first}")
        if about["hybrid"]:
            words = self._by_shelf().read.schema(PART_SCHEMA).parquet(f"{self._at(name)}/{part}").filter("n_terms > 0").select(_file().alias("file"), "id", F.col("n_terms").alias("dl"), F.array_join(toks, " ").alias("words"))
            made = words.mapInArrow(_shelved(SHELF_CHARS), f"shelf long, {BLOCK_SCHEMA}")
            made.sortWithinPartitions("shelf", "term", "span").write.option("compression", "zstd").partitionBy("shelf").parquet(f"{self._at(name)}/terms-{part}")
            about["shelved"] = [*about.get("shelved", []), part]
        return {part: [n, terms]}

    def _by_shelf(self) -> SparkSession:
        """A session whose tasks read a row group or two, so that the blocks that one of them sorts stay in memory."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
        session.conf.set("spark.sql.files.openCostInBytes", str(SPLIT_BYTES // 8))
        return session

    def _stored(self, name: str, part: str, rows: DataFrame, group: int = SHELF_CHARS) -> DataFrame:
        """The rows as files of a part, sorted by id within each, in row groups of about so many bytes."""
        at = f"{self._at(name)}/{part}"
        rows.sortWithinPartitions("id").write.option("compression", "zstd").option("parquet.block.size", str(group)).option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.enabled#relative_path", "true").parquet(at)
        return self.spark.read.schema(PART_SCHEMA).parquet(at)

    def _commit(self, name: str, at: int, about: dict, parts: dict, gone: dict) -> None:
        """Make these parts and deletions current; what is no longer needed is retired, and goes once ``retention`` is over."""
        gone = {g: held for g, held in gone.items() if held.keys() & parts.keys()}
        needed = parts.keys() | gone.keys()
        retired = about["retired"] | {f: time.time() for f in about["parts"].keys() | about["gone"].keys() if f not in needed}
        over = [f for f, since in retired.items() if since + self.retention <= time.time()]
        version = max(parts, default=None) if parts.keys() - about["parts"].keys() else about["version"] if parts else None
        self._pointer(name).move(at, about | {"version": version, "parts": parts, "shelved": [p for p in about.get("shelved", []) if p in parts], "gone": gone, "retired": {f: t for f, t in retired.items() if f not in over}})
        for folder in over:
            self.files.delete(f"{self._at(name)}/{folder}")
            self.files.delete(f"{self._at(name)}/terms-{folder}")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append rows; one new part, visible once complete."""
        at, about = self._current(name)
        self._commit(name, at, about, about["parts"] | self._written(name, about, rows), about["gone"])

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new state with exactly these rows (which may be derived from the current one)."""
        at, about = self._current(name)
        self._commit(name, at, about, self._written(name, about, rows), {})

    def _deleted(self, name: str, about: dict, column: str, stale: list[str] | DataFrame) -> dict:
        """A deletion vector for the rows whose ``column`` has one of these values, and its counts by part."""
        rows = lambda found: found.select("part", "file", column, "n_terms", *([] if column == "id" else ["id"]))
        if isinstance(stale, DataFrame):
            keys = stale.select(column).distinct()
            few = [r[0] for r in keys.limit(10 * PUSHED + 1).collect()]
            stale = few if len(few) <= 10 * PUSHED else keys
        if isinstance(stale, DataFrame):
            hit = self._live(name, about, PART_SCHEMA, rows=rows).join(stale, column, "left_semi")
        else:
            hit = self._live(name, about, PART_SCHEMA, where=any_of(column, stale), rows=rows)
        folder = f"gone-{uuid.uuid4().hex}"
        hit.select("part", "file", "id", "n_terms").write.parquet(f"{self._at(name)}/{folder}")
        counts = self.spark.read.schema(f"{GONE_SCHEMA}, n_terms long").parquet(f"{self._at(name)}/{folder}").groupBy("part").agg(F.count("*"), F.sum("n_terms")).collect()  # one row for each part
        if not counts:
            self.files.delete(f"{self._at(name)}/{folder}")
            return {}
        return {folder: {part: [n, terms] for part, n, terms in counts}}

    def delete(self, name: str, ids: list[str] | DataFrame) -> None:
        """Delete rows by id: their ids are written, nothing else is."""
        self.change(name, "id", ids)

    def change(self, name: str, column: str, stale: list[str] | DataFrame, rows: DataFrame | None = None) -> None:
        """In one commit, delete the rows whose ``column`` has one of the stale values, and append ``rows``."""
        at, about = self._current(name)
        gone = self._deleted(name, about, column, stale)
        new = {} if rows is None else self._written(name, about, rows)
        if gone or new:
            self._commit(name, at, about, about["parts"] | new, about["gone"] | gone)

    def set_vectors(self, name: str, at: int, folder: str, parts: list[str]) -> None:
        """Make a vector index over these parts current, if nothing was committed since ``at``; the one before is retired."""
        about = self._current(name)[1]
        old = about.get("vectors", {}).get("folder")
        retired = about["retired"] | ({old: time.time()} if old else {})
        self._pointer(name).move(at, about | {"vectors": {"folder": folder, "parts": parts}, "retired": retired})

    def lost(self, name: str, parts: list[str]) -> int:
        """How many rows of these parts are gone, deleted or with their part."""
        about = self.describe(name)
        return sum(n for g in about["gone"].values() for p, (n, _) in g.items() if p in parts and p in about["parts"])

    def compact(self, name: str, share: float = GONE_SHARE, most: int = MOST_PARTS) -> list[str]:
        """Rewrite parts that are mostly deleted, and the smaller half where there are more than ``most``; returns what was rewritten."""
        at, about = self._current(name)
        lost = {p: sum(g[p][0] for g in about["gone"].values() if p in g) for p in about["parts"]}
        old = {p for p, (n, _) in about["parts"].items() if not n or lost[p] > share * n}
        if len(about["parts"]) - len(old) > most:
            old |= set(sorted(about["parts"], key=lambda p: about["parts"][p][0])[: len(about["parts"]) // 2])
        if old:
            rows = self._live(name, about | {"parts": {p: about["parts"][p] for p in old}}, PART_SCHEMA)
            kept = {p: n for p, n in about["parts"].items() if p not in old}
            left = any(about["parts"][p][0] > lost[p] for p in old)
            self._commit(name, at, about, kept | (self._written(name, about, rows) if left else {}), about["gone"])
        return sorted(old)

    def vacuum(self, name: str) -> None:
        """Delete all that does not belong to the current state, also what a failed writer left: no one else may be at it."""
        at, about = self._current(name)
        for entry in self.files.names(self._at(name)):
            if entry.startswith(("part-", "terms-", "gone-", "vectors-")) and entry.removeprefix("terms-") not in about["parts"].keys() | about["gone"].keys() | {about.get("vectors", {}).get("folder")}:
                self.files.delete(f"{self._at(name)}/{entry}")
        if about["retired"]:
            self._pointer(name).move(at, about | {"retired": {}})
