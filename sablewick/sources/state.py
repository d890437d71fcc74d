"""Persistent state: file hashes per tree, index status per codebase, and the repository registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablewick.sources.store import Files, Pointer

STATE = "relative_path string, hash string"
STATUS = "codebase_path string, status string, indexing_percentage double, indexed_files long, total_chunks long, index_status string, error_message string, last_attempted_percentage double, last_updated timestamp"
FAILURES = "relative_path string, id string, attempts int, error string, retry_at timestamp"
REGISTRY = "id string, owner string, repo string, collection_name string, indexed_at timestamp, last_search_at timestamp, total_files long, total_chunks long"


class Versioned:
    """One DataFrame by name, replaced as a whole: write a version, then move the pointer.

    The version before stays until the next one, for those who are reading it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema, self.files = spark, root.rstrip("/"), schema, Files(spark, root)

    def _pointer(self, key: str) -> Pointer:
        return Pointer(self.files, self.root, key)

    def load(self, key: str) -> DataFrame | None:
        found = self._pointer(key).read()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{found[1]['version']}") if found else None

    def save(self, key: str, rows: DataFrame) -> None:
        version = f"{key}-{uuid.uuid4().hex}"
        at, before = self._pointer(key).read() or (0, {})
        rows.write.parquet(f"{self.root}/{version}")
        self._pointer(key).move(at, {"version": version, "before": before.get("version")})
        if before.get("before"):
            self.files.delete(f"{self.root}/{before['before']}")

    def delete(self, key: str) -> None:
        found = self._pointer(key).read()
        self._pointer(key).delete()
        for version in filter(None, (found[1]["version"], found[1].get("before")) if found else ()):
            self.files.delete(f"{self.root}/{version}")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def status_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A status snapshot file of either version as a status table.

    The first version lists paths; what was still indexing then counts as not
    indexed, and so does an interrupted ``indexing`` entry of the second.
    """
    raw = spark.read.text(path, wholetext=True)
    second = "struct<formatVersion:string,codebases:map<string,struct<status:string,indexingPercentage:double,indexedFiles:bigint,totalChunks:bigint,indexStatus:string,errorMessage:string,lastAttemptedPercentage:double,lastUpdated:timestamp>>>"
    first = "struct<indexedCodebases:array<string>,lastUpdated:timestamp>"
    new = raw.select(F.explode(F.map_entries(F.from_json("value", second)["codebases"])).alias("e")).select(
        F.col("e.key").alias("codebase_path"), F.col("e.value.status").alias("status"), F.col("e.value.indexingPercentage").alias("indexing_percentage"),
        F.col("e.value.indexedFiles").alias("indexed_files"), F.col("e.value.totalChunks").alias("total_chunks"), F.col("e.value.indexStatus").alias("index_status"),
        F.col("e.value.errorMessage").alias("error_message"), F.col("e.value.lastAttemptedPercentage").alias("last_attempted_percentage"), F.col("e.value.lastUpdated").alias("last_updated"),
    )
    old = raw.select(F.from_json("value", first).alias("v")).select(F.explode("v.indexedCodebases").alias("codebase_path"), F.lit("indexed").alias("status"), F.lit("completed").alias("index_status"), F.col("v.lastUpdated").alias("last_updated"))
    return new.unionByName(old, allowMissingColumns=True).filter("status <> 'indexing'")


def migrated(spark: SparkSession, statuses: Versioned, path: str, there: Callable[[str], bool], name: str = "status") -> list[str]:
    """Take a status file into the saved table, but for trees that ``there`` denies; returns the paths that were left out.

    Entries saved already stay as they are.  The file may be of either version, and
    is not needed again.
    """
    rows = status_from_json(spark, path)
    known = [r["codebase_path"] for r in rows.select("codebase_path").distinct().collect()]  # one row for each codebase
    lost = sorted(p for p in known if not there(p))
    saved = statuses.load(name)
    saved = spark.createDataFrame([], STATUS) if saved is None else saved
    rows = spark.createDataFrame([], STATUS).unionByName(rows, allowMissingColumns=True)
    statuses.save(name, upsert(rows.filter(~F.col("codebase_path").isin(lost)), saved, "codebase_path"))
    return lost


def status_of(table: DataFrame, path: str) -> str:
    row = table.filter(F.col("codebase_path") == path).select("status").first()
    return row["status"] if row else "not_found"


def recent(registry: DataFrame, n: int = 5) -> DataFrame:
    """The newest entry of each id, the ``n`` newest of those."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("indexed_at")))
    return registry.withColumn("__rank", rank).filter("__rank = 1").drop("__rank").orderBy(F.desc("indexed_at"), "id").limit(n)


def younger(registry: DataFrame, now, days: int = 30) -> DataFrame:
    return registry.filter(F.col("indexed_at") > F.lit(now) - F.make_dt_interval(F.lit(days)))


class Registry:
    """The indexed repositories: newest entry of each, the five newest of all."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 5):
        self.table, self.spark, self.keep = Versioned(spark, root, REGISTRY), spark, keep

    def rows(self) -> DataFrame:
        found = self.table.load("registry")
        return found if found is not None else self.spark.createDataFrame([], REGISTRY)

    def add(self, rows: DataFrame) -> None:
        self.table.save("registry", recent(upsert(self.rows(), rows, "id"), self.keep))

    def find(self, repo_id: str) -> DataFrame:
        return self.rows().filter(F.col("id") == repo_id)

    def remove(self, repo_id: str) -> None:
        self.table.save("registry", self.rows().filter(F.col("id") != repo_id))

    def touch(self, repo_id: str) -> None:
        """Note that a repository was searched now."""
        now = F.when(F.col("id") == repo_id, F.current_timestamp()).otherwise(F.col("last_search_at"))
        self.table.save("registry", self.rows().withColumn("last_search_at", now))

    def reconcile(self, exists) -> list[str]:
        """Drop entries whose collection ``exists(name)`` denies; returns their ids."""
        known = self.rows().select("id", "collection_name").collect()  # at most ``keep`` rows
        gone = [r["id"] for r in known if not exists(r["collection_name"])]
        if gone:
            self.table.save("registry", self.rows().filter(~F.col("id").isin(gone)))
        return gone

    def clean(self, now, days: int = 30) -> None:
        self.table.save("registry", younger(self.rows(), now, days))
