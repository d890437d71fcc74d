"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, groups whole.

Documents with equal texts form a group that no shard boundary cuts.  Groups
heavier than two mean bundles are items of their own, and all others are dealt
into ``bundles`` bundles by their digest; with b bundles there are fewer than
b / 2 heavy groups, so the driver differences at most 1.5 b items whatever the
input, and what it sends to tasks is as small.  Heavy groups are looked for only
in bundles that are heavy enough to hold one.

Differencing keeps a partial partition (one load for each shard) for every item
and repeatedly replaces the two with the largest spread by their sum, the heaviest
load of one on the lightest of the other.  The last one left is the partition.

Rows are numbered within their shard without being gathered: each task numbers
its own rows, which are written with the task's number, and a running sum over
the tasks' counts gives where each task's numbers begin.

Defined results
---------------
* size: UTF-8 bytes of the text plus ``OVERHEAD``; null text: no bytes, in one
  group with empty texts;
* a group heavier than a whole shard's share: has a shard with as little else as
  differencing finds, since groups stay whole;
* fewer groups than shards: the shards left over are empty;
* ties: by digest, so the shards are the same on every run; slots follow the order
  in which rows are stored;
* repeated rows: each has its own slot; null doc_id: as any other;
* empty table: no rows; extra columns: ignored, kept by ``sharded_rows``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, IntegerType, StructField, StructType

from sablewick.llm import common

SHARDS, OVERHEAD, BUNDLES = 40, 16, 8192
#: Counts of (task, shard) up to this many rows are sent to every task; more are joined by a shuffle.
FEW_COUNTS = 100_000


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item."""
    if not sizes:
        return []
    leaf = np.zeros(shards, np.int64)
    loads = []  # of each partial partition, ascending from 0
    for size in sizes:
        own = leaf.copy()
        own[-1] = size if shards > 1 else 0
        loads.append(own)
    made: list[tuple[int, int, np.ndarray]] = []  # the two that were combined, and the order that their sums were brought into
    heap = [(-int(own[-1]), k) for k, own in enumerate(loads)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, one), (_, other) = heapq.heappop(heap), heapq.heappop(heap)
        both = loads[one] + loads[other][::-1]
        loads[one] = loads[other] = leaf
        order = both.argsort(kind="stable")
        both = both[order] - both[order[0]]
        made.append((one, other, order))
        heapq.heappush(heap, (-int(both[-1]), len(loads)))
        loads.append(both)
    # From the whole back to the items: which shard each load of each partial partition went to.
    shard_of: list[np.ndarray | None] = [None] * len(loads)
    shard_of[-1] = np.arange(shards)
    for k in range(len(made) - 1, -1, -1):
        one, other, order = made[k]
        own = np.empty(shards, np.int64)
        own[order] = shard_of[len(sizes) + k]
        shard_of[one], shard_of[other], shard_of[len(sizes) + k] = own, own[::-1], None
    return [int(own[-1]) for own in shard_of[: len(sizes)]]


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def bundle_of(digest: Column, bundles: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bundles)).cast("int")


def plan(rows: DataFrame, shards: int, bundles: int) -> tuple[list[int], dict[bytes, int]]:
    """The shard of each bundle, and of each heavy group, from rows of (digest, bundle, size)."""
    masses = dict(rows.groupBy("bundle").agg(F.sum("size").alias("mass")).collect())  # one row for each bundle
    least = 2 * sum(masses.values()) / bundles
    crowded = [b for b, mass in masses.items() if mass > least]
    heavy: dict[bytes, int] = {}
    if crowded:
        groups = rows.filter(F.col("bundle").isin(crowded)).groupBy("digest", "bundle").agg(F.sum("size").alias("mass")).filter(F.col("mass") > least)
        for digest, bundle, mass in groups.collect():  # fewer than half as many as bundles
            heavy[bytes(digest)] = mass
            masses[bundle] -= mass
    items = [(masses[b], b) for b in sorted(masses) if masses[b]] + [(heavy[d], d) for d in sorted(heavy)]
    of_bundle, of_group = [0] * bundles, {}
    for (_, item), shard in zip(items, differenced([size for size, _ in items], shards)):
        if isinstance(item, bytes):
            of_group[item] = shard
        else:
            of_bundle[item] = shard
    return of_bundle, of_group


def dealt(rows: DataFrame, of_bundle: list[int], of_group: dict[bytes, int]) -> DataFrame:
    """Adds shard, task and place (the row's number within its task and shard) to rows of (..., digest, bundle)."""
    sent = rows.sparkSession.sparkContext.broadcast((np.array(of_bundle, np.int32), of_group))  # bounded by the number of bundles
    kept = [f for f in rows.schema.fields if f.name not in ("digest", "bundle")]
    schema = StructType([*kept, StructField("shard", IntegerType()), StructField("task", IntegerType()), StructField("place", LongType())])
    arrow = to_arrow_schema(schema)
    digest_at, bundle_at = rows.columns.index("digest"), rows.columns.index("bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bundle, of_group = sent.value
        task, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            shard = of_bundle[np.asarray(batch.column(bundle_at))]
            if of_group:
                own = [of_group.get(d, -1) for d in batch.column(digest_at).to_pylist()]
                shard = np.where(np.array(own, np.int32) >= 0, own, shard)
            place = np.zeros(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                place[mine] = counts.get(s, 0) + np.arange(len(mine))
                counts[s] = counts.get(s, 0) + len(mine)
            columns = [batch.column(rows_at) for rows_at in kept_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard, pa.int32()), pa.array(np.full(len(shard), task, np.int32)), pa.array(place)], schema=arrow)

    kept_at = [rows.columns.index(f.name) for f in kept]
    return rows.mapInArrow(run, schema)


def numbered(rows: DataFrame, few_counts: int = FEW_COUNTS) -> DataFrame:
    """Turns (task, place) into slot, gapless from 0 in each shard; ``rows`` must be stored."""
    counts = common.written(rows.groupBy("shard", "task").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(F.col("shard").alias("__sw_shard"), F.col("task").alias("__sw_task"), F.coalesce(before, F.lit(0)).alias("__sw_begin"))
    begins = F.broadcast(begins) if counts.count() <= few_counts else begins.hint("merge")
    joined = rows.join(begins, (F.col("shard") == F.col("__sw_shard")) & (F.col("task") == F.col("__sw_task")))
    return joined.withColumn("slot", F.col("__sw_begin") + F.col("place")).drop("__sw_shard", "__sw_task", "__sw_begin", "task", "place")


def assign_shards(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: sizes decide here) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text_digest(F.col("text")).alias("digest"))
    rows = common.written(rows.withColumn("bundle", bundle_of(F.col("digest"), bundles)), "sizes")
    placed = numbered(common.written(dealt(rows, *plan(rows, shards, bundles)), "dealt"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_rows(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """The rows of ``docs``, whole, as one struct ``row`` beside their shard: ready to be written with ``partitionBy("shard")``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), text_digest(F.col("text")).alias("digest"))
    whole = whole.withColumn("bundle", bundle_of(F.col("digest"), bundles))
    planned = plan(common.written(whole.select("digest", "bundle", "size"), "sizes"), shards, bundles)
    return dealt(whole.select("row", "digest", "bundle"), *planned).select("row", "shard")
