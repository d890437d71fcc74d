"""Incremental sync: snapshot differences, Merkle roots, reindexing, reconciliation.

A state is a DataFrame (relative_path, hash).  Every comparison is one equi-join
on the path or an anti-join; nothing is held in driver memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewick.functions import ids


def file_state(files: DataFrame, path_col: str = "relative_path", text_col: str = "content") -> DataFrame:
    return files.select(F.col(path_col).alias("relative_path"), ids.file_hash(F.col(text_col)).alias("hash"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(relative_path, change): added, removed or modified."""
    both = old.select("relative_path", F.col("hash").alias("old_hash")).join(new.select("relative_path", F.col("hash").alias("new_hash")), "relative_path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return both.select("relative_path", change.alias("change")).filter("change IS NOT NULL")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def merkle_nodes(state: DataFrame) -> DataFrame:
    """Leaf nodes: id = SHA-256 of ``path:hash``."""
    data = F.concat_ws(":", "relative_path", "hash")
    return state.select("relative_path", F.sha2(data, 256).alias("id"), data.alias("data"))


def merkle_tree(state: DataFrame) -> DataFrame:
    """All nodes (id, data, parent, relative_path): the leaves, and above them the one root, whose parent is null."""
    leaves = merkle_nodes(state)
    root = merkle_root(state).select(F.col("root").alias("id"), F.lit("root").alias("data"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("relative_path"))
    return leaves.crossJoin(F.broadcast(root.select(F.col("id").alias("parent")))).select("id", "data", "parent", "relative_path").unionByName(root)  # root is one row


def merkle_node(tree: DataFrame, node_id: str) -> DataFrame:
    return tree.filter(F.col("id") == node_id)


def root_nodes(tree: DataFrame) -> DataFrame:
    return tree.filter("parent IS NULL")


def leaf_nodes(tree: DataFrame) -> DataFrame:
    return tree.filter("parent IS NOT NULL")


def merkle_root(state: DataFrame) -> DataFrame:
    """One row: SHA-256 of ``root:`` and all file hashes in path order.

    The definition is one digest over all hashes, so one task reads them; it
    sorts them with spilling and hashes them as a stream, and never holds them.
    ``bucketed_root`` is the parallel form for very large trees.
    """
    ordered = state.select("relative_path", "hash").repartition(1).sortWithinPartitions("relative_path", "hash").select("hash")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = hashlib.sha256(b"root:")
        for batch in batches:
            root.update("".join(batch.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_pydict({"root": [root.hexdigest()]})

    return ordered.mapInArrow(digest, "root string")


def bucketed_root(state: DataFrame, buckets: int = 4096) -> DataFrame:
    """A root over roots of hash buckets: equal trees give equal roots, and no task holds more than a bucket."""
    key = F.pmod(F.xxhash64("relative_path"), F.lit(buckets)).alias("bucket")
    leaf = F.array_sort(F.collect_list(F.struct("relative_path", "hash")))
    inner = state.groupBy(key).agg(F.sha2(F.array_join(F.transform(leaf, lambda x: F.concat_ws(":", x["relative_path"], x["hash"])), "\n"), 256).alias("hash"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "hash")))
    return inner.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["hash"]), ""), 256).alias("root"))


NODES = "path string, depth int, parent string, digest string, n_files long"


def directory_nodes(state: DataFrame) -> DataFrame:
    """A Merkle tree by directory: (path, depth, parent, digest, n_files) of every directory, the root being ``''``.

    A directory's digest is made of the digests of all files below it, combined by
    exclusive or, so each task combines its own files first and no directory's
    files are ever brought together.
    """
    parts = F.split("relative_path", "/")
    path = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, 1, d), "/"))
    leaf = F.sha2(F.concat_ws(":", "relative_path", "hash"), 256)
    rows = state.select(F.posexplode(path).alias("depth", "path"), leaf.alias("leaf"))
    words = [F.bit_xor(F.conv(F.substring("leaf", 1 + 15 * k, 15), 16, 10).cast("long")).alias(f"w{k}") for k in range(4)]
    nodes = rows.groupBy("path", "depth").agg(F.count("*").alias("n_files"), *words)
    digest = F.sha2(F.concat_ws(":", *[F.col(f"w{k}") for k in range(4)], "n_files"), 256)
    parent = F.when(F.col("depth") > 0, F.regexp_replace("path", "/?[^/]*$", ""))
    return nodes.select("path", "depth", parent.alias("parent"), digest.alias("digest"), "n_files")


def changed_directories(old: DataFrame, new: DataFrame, few: int = 1000, told: list[int] | None = None) -> DataFrame:
    """The directories (path) with different digests, found from the root downwards.

    Only children of differing directories are compared, by a filter on their
    parent; where a level has more than ``few`` differing ones, all levels below are
    compared in one join.  ``told`` gets the number of nodes that were compared.
    """
    spark, found, level = old.sparkSession, [], None

    def differing(where) -> DataFrame:
        one, other = (n.filter(where).select("path", F.col("digest").alias(c)) for n, c in ((old, "a"), (new, "b")))
        return one.join(other, "path", "full_outer")

    depth = 0
    while level is None or level:
        where = (F.col("depth") == depth) if level is None else (F.col("depth") == depth) & F.col("parent").isin(level)
        rows = differing(where)
        if told is not None:
            told.append(rows.count())
        rows = rows.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")
        some = [r["path"] for r in rows.limit(few + 1).collect()]
        if len(some) > few:
            below = differing(F.col("depth") >= depth).filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")
            return below.unionByName(spark.createDataFrame([(p,) for p in found], "path string"))
        found, level, depth = found + some, some, depth + 1
    return spark.createDataFrame([(p,) for p in found], "path string")


def tree_diff(old: DataFrame, new: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """``snapshot_diff`` of the files directly in directories that differ; the others are not compared."""
    changed = changed_directories(old_nodes, new_nodes)
    folder = F.regexp_replace("relative_path", "/?[^/]*$", "")
    few = [r["path"] for r in changed.limit(1001).collect()]
    if len(few) <= 1000:
        return snapshot_diff(old.filter(folder.isin(few)), new.filter(folder.isin(few)))
    return snapshot_diff(*[s.withColumn("path", folder).join(changed, "path", "left_semi") for s in (old, new)])


def node_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) of Merkle nodes on one side only."""
    gone = old.select("id").join(new.select("id"), "id", "left_anti").withColumn("change", F.lit("removed"))
    return new.select("id").join(old.select("id"), "id", "left_anti").withColumn("change", F.lit("added")).unionByName(gone)


def reindex(chunks: DataFrame, diff: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks after a sync: those of unchanged files, and the new chunks of added and modified ones."""
    stale = diff.filter(F.col("change").isin("removed", "modified")).select("relative_path")
    fresh = diff.filter(F.col("change").isin("added", "modified")).select("relative_path")
    return chunks.join(stale, "relative_path", "left_anti").unionByName(new_chunks.join(fresh, "relative_path", "left_semi"))


def delete_ids(rows: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.join(gone.select(id_col), id_col, "left_anti")


def reconcile(local: DataFrame, remote: DataFrame, key: str = "codebase_path") -> DataFrame:
    """Local entries with ``keep``: whether the remote side knows them; none are added."""
    known = remote.select(key).distinct().withColumn("__known", F.lit(True))
    return local.join(known, key, "left").withColumn("keep", F.coalesce("__known", F.lit(False))).drop("__known")


def remaining(instances: DataFrame, done: DataFrame, most: int, id_col: str = "instance_id") -> DataFrame:
    """Instances not done yet, in order, up to ``most`` less the number done."""
    left = max(0, most - done.select(id_col).distinct().count())
    rest = instances.join(done.select(id_col), id_col, "left_anti").orderBy(id_col)
    return rest if left >= instances.count() else rest.limit(left)  # a limit would end in one task
