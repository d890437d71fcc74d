"""Filtering stages: what an operator decides, applied to whole rows.

Each takes rows with (at least) doc_id and text and returns rows with the same
columns.  Nulls, ties, repeated rows and clashing names are handled as the
operator's own module states; rows with a null doc_id are never dropped as near
copies, since nothing names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewick.llm import common, langid, toxicity
from sablewick.llm.exact_dedup import keep_one, passing_index
from sablewick.llm.ngram_join import THRESHOLD, jaccard_join

#: A text is rejected if no language has this share of its letters.
LEAST_SHARE = 0.4


def keep_identified(docs: DataFrame, model: langid.Model, least_share: float = LEAST_SHARE) -> DataFrame:
    """Drop texts without a letter, and texts in which no language has ``least_share`` of the letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list) -> list[bool]:
        languages, scores = langid.predict(shared.value, ["" if t is None else t for t in texts])
        return [name != langid.UNKNOWN and score >= least_share for name, score in zip(languages, scores)]

    return common.keep_rows(docs, "text", keep)


def drop_toxic(docs: DataFrame, net: toxicity.Network, threshold: float = 0.5) -> DataFrame:
    """Drop texts that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return common.keep_rows(docs, "text", lambda texts: (shared.value.score(["" if t is None else t for t in texts]) < threshold).tolist())


def drop_copies(docs: DataFrame) -> DataFrame:
    """Keep one row of each text (A-Z lower-cased): the one with the largest doc_id."""
    with passing_index(docs.sparkSession) as index:
        return keep_one(docs, index)


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Keep one document, that with the smallest doc_id, of each group that near-copy links connect."""
    stays = jaccard_join(docs, threshold).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("id")).distinct()
    # Rows travel as one struct, so their columns' names cannot clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"))
    return rows.join(stays, F.col("own_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")
