"""Keeping an index fresh as a stream.

A ``ChangeLog`` turns a source tree into numbered versions of changes.  To advance
it is a batch job: executors list the tree's sizes and times, only files in which
either changed since the last version are read and hashed, and what differs from
the recorded state is written as the next version.  The state lies in a table by
path, never with the driver.

The stream is Spark's own stream of files over the versions, so an offset is the
number of what has been read and has the same size for a tree of any size.
``Poller`` advances the log and hands each new version to ``foreachBatch``; one batch
runs at a time, and a failed one is run again.  A version that is written again,
since the driver was lost before the state was saved, may be handed on twice.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sablewick.sources.codefiles import read_stats
from sablewick.sources.state import Versioned

CHANGES = "relative_path string, change string, hash string, content string"
SEEN = "relative_path string, size long, modified long, hash string"


def contents(paths: DataFrame, root: str) -> DataFrame:
    """(relative_path, content, hash) of files, read where the rows are; what can't be read is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for relative in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, relative), "rb") as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"relative_path": [relative], "content": [text], "hash": [hashlib.sha256(text.encode()).hexdigest()]})

    return paths.select("relative_path").mapInArrow(run, "relative_path string, content string, hash string")


class ChangeLog:
    """The changes of one tree, below one folder: ``changes/version-<number>`` and the state they lead to."""

    def __init__(self, spark: SparkSession, path: str, folder: str, **options):
        self.spark, self.path, self.folder, self.options = spark, os.path.abspath(path), folder.rstrip("/"), options
        self.states = Versioned(spark, f"{self.folder}/state", SEEN)
        self.changes = f"{self.folder}/changes"

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        found = [n for n in self.states.files.names(self.changes) if n.startswith("version-")]
        return max((int(n.removeprefix("version-")) for n in found if self.states.files.exists(f"{self.changes}/{n}/_SUCCESS")), default=0)

    def advance(self) -> int:
        """Write what has changed as the next version, if anything has; returns the last version's number."""
        old = self.states.load("seen")
        old = self.spark.createDataFrame([], SEEN) if old is None else old
        at, scratch = self.version(), f"{self.folder}/scratch"
        read_stats(self.spark, self.path, **self.options).write.mode("overwrite").parquet(f"{scratch}/stats")
        stats = self.spark.read.parquet(f"{scratch}/stats")
        before = old.select("relative_path", F.col("size").alias("s"), F.col("modified").alias("m"), F.col("hash").alias("h"))
        touched = stats.join(before, ["relative_path"], "left").filter(~(F.col("size").eqNullSafe(F.col("s")) & F.col("modified").eqNullSafe(F.col("m"))))
        contents(touched, self.path).write.mode("overwrite").parquet(f"{scratch}/read")
        fresh = self.spark.read.parquet(f"{scratch}/read")
        changed = fresh.join(before.select("relative_path", "h"), "relative_path", "left").filter(~F.col("hash").eqNullSafe(F.col("h")))
        changed = changed.select("relative_path", F.when(F.col("h").isNull(), "added").otherwise("modified").alias("change"), "hash", "content")
        gone = old.join(stats, "relative_path", "left_anti").select("relative_path", F.lit("removed").alias("change"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("content"))
        rows = changed.unionByName(gone)
        if rows.isEmpty() and touched.isEmpty():
            return at
        if not rows.isEmpty():
            at += 1
            rows.write.mode("overwrite").parquet(f"{self.changes}/version-{at:012d}")
        # What was read has its new size, time and hash; what could not be read keeps what was recorded, and is tried again.
        known = stats.join(fresh.select("relative_path", "hash"), "relative_path").select("relative_path", "size", "modified", "hash")
        kept = old.join(known, "relative_path", "left_anti").join(stats, "relative_path", "left_semi")
        self.states.save("seen", known.unionByName(kept))
        return at

    def stream(self) -> DataFrame:
        """All versions, as a stream."""
        return self.spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(self.changes)


class Poller:
    """Applies a tree's changes to an index, on a timer or once."""

    def __init__(self, spark: SparkSession, path: str, apply: Callable[[DataFrame, int], None], checkpoint: str, **options):
        self.log = ChangeLog(spark, path, f"{checkpoint}/log", **options)
        self.spark, self.apply, self.checkpoint, self.ticker = spark, apply, checkpoint, None

    def start(self, minutes: float | None = 5) -> StreamingQuery:
        """Every ``minutes``, or once over all that is there if None."""
        self.log.states.files.make(self.log.changes)
        writer = self.log.stream().writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.checkpoint}/applied")
        if minutes is None:
            self.log.advance()
            return writer.trigger(availableNow=True).start()
        every = f"{max(1, int(minutes * 60))} seconds"
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream
        self.ticker = ticks.foreachBatch(lambda _, __: self.log.advance()).option("checkpointLocation", f"{self.checkpoint}/ticks").trigger(processingTime=every).start()
        return writer.trigger(processingTime=every).start()

    def stop(self) -> None:
        """End the timer; the query that ``start`` returned is its caller's."""
        if self.ticker:
            self.ticker.stop()


def event_counts(events: DataFrame, checkpoint: str, name: str, window: str = "1 day") -> StreamingQuery:
    """Event-time counts with a watermark, written to a memory table: a stream over ``events`` rows."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
