"""Exact dedup [native]: a persistent digest index, bucketed and sorted by digest.

A batch is reduced to one row per digest before anything is joined; those rows
meet the index in a sort-merge anti-join, and the digests that the index does
not hold yet are appended to it.  The index is bucketed by digest, so it is never
exchanged; only the batch's groups are, to its buckets.

A batch holds the index for itself while it is joined and appended: of two
writers that meet, the second raises ``Conflict`` and can be run again.  Appends
leave one more file in each bucket; ``compact`` turns them into one again.

What a batch returns depends on its own rows and on the documents recorded for
their digests, and those never change.  So a batch that is run again, after a
failure at any step or for any other reason, returns the same rows.

Only DataFrame functions are used.  A digest that a third of all rows share is
pre-aggregated before its exchange, and the look-up that gives each row its
group joins on a derived key so that adaptive execution can split it.

Defined results
---------------
* null text: the empty text, equal to other empty texts;
* equal texts: identical after lower-casing A-Z only; of a batch's equal texts
  the row with the largest doc_id stays (a null doc_id counts as smallest), and
  a digest already in the index keeps the document recorded there (of several, the
  largest, should it have been recorded more than once);
* ``group_size`` counts the batch's rows with this text, whatever came before;
* repeated rows (same doc_id and equal text): one document; all carry its
  verdict, and ``keep_one`` returns a single row for it;
* empty table: no rows, the index is unchanged;
* extra columns, whatever their names: ignored here, kept by ``keep_one``.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewick.llm import common
from sablewick.sources.store import Conflict, Files, Pointer

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text's UTF-8 after lower-casing A-Z."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), 256)


class DigestIndex:
    """A bucketed table ``(text_sha256, keep_id)``.

    With ``path`` the table lies there: another session, whose catalogue does
    not know it, opens the same index by giving the same path and number of
    buckets.  Without, it is a managed table of the catalogue.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            place = f" LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {name} (text_sha256 STRING, keep_id BIGINT) USING parquet "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS{place}"
            )

        place = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"].rstrip("/")
        self.beside = f"{place}_writer"
        self.held = Pointer(Files(spark, self.beside), self.beside, "held")

    def _append(self, rows: DataFrame) -> None:
        (rows.write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name))

    @contextmanager
    def alone(self, patience: float = 86400.0):
        """Hold the index; a writer that has held it for longer than ``patience`` seconds counts as lost."""
        at, now = self.held.read() or (0, {})
        if now.get("writer") and time.time() - now["since"] < patience:
            raise Conflict(f"{self.name} is being written")
        self.held.move(at, {"writer": uuid.uuid4().hex, "since": time.time()})
        try:
            yield
        finally:
            self.held.move(at + 1, {"writer": None})

    def read(self) -> DataFrame:
        """One row for each digest; digests are together in their bucket, so nothing is exchanged."""
        return self.spark.table(self.name).groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.held.files.delete(self.beside)

    def add(self, groups: DataFrame) -> None:
        """Append the groups whose digest is not indexed yet (sort-merge anti-join)."""
        with self.alone():
            known = self.spark.table(self.name).select("text_sha256").hint("merge")
            self._append(groups.hint("merge").join(known, "text_sha256", "left_anti").select("text_sha256", "keep_id"))

    def compact(self) -> None:
        """One sorted file for each bucket, each digest once."""
        with self.alone():
            rows = common.written(self.read(), "compacted")
            rows.repartition(self.buckets, "text_sha256").write.mode("overwrite").insertInto(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The index is read and written before this returns; the rows no longer depend on it.
    """
    rows = common.written(docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256")), "digests")
    # Written, so that the optimiser cannot push the joins with the index below this aggregate: a join there would exchange every row.
    groups = common.written(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    index.add(groups)
    found = groups.drop("keep_id").join(index.read().hint("merge"), "text_sha256").select(common.image(F.col("text_sha256")).alias("image"), "keep_id", "group_size")
    found = common.written(found, "found")
    return (
        rows.withColumn("image", common.image(F.col("text_sha256")))
        .join(found, "image")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


@contextmanager
def passing_index(spark: SparkSession):
    """An index for one run, gone afterwards."""
    index = DigestIndex(spark, f"sablewick_digests_{uuid.uuid4().hex}")
    try:
        yield index
    finally:
        index.drop()


def keep_one(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, one for each text.

    Rows go back to their verdict by doc_id and digest; those few that are
    repeated outright (same doc_id, equal text) pass a ``dropDuplicates``.
    """
    verdict = exact_dedup(docs, index).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    verdict = common.written(verdict, "kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "copies")
    # Rows travel as one struct, so their columns' names cannot clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), text_digest(F.col("text")).alias("own"))
    kept = rows.join(verdict, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")))
    single = kept.filter("copies = 1").select("row.*")
    if verdict.filter("copies > 1").isEmpty():
        return single
    return single.unionByName(kept.filter("copies > 1").dropDuplicates(["own_id", "own"]).select("row.*"))
