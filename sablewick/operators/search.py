"""Dense, full-text and hybrid search.

All searches filter before they rank, tie-break by id, and take their top rows
with ``orderBy(...).limit(...)`` (each task keeps only that many) or, for many
queries at once, with a ranked window that Spark prunes per partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewick.functions import text as text_
from sablewick.functions import values
from sablewick.functions.vectors import cosine_to
from sablewick.sources.store import any_of

#: Most queries that are sent to every task at once.
QUERY_BLOCK = 1000


def dense_topk(docs: DataFrame, query: Sequence[float], k: int = values.DENSE_LIMIT, *, id_col: str = "id", vector_col: str = "vector", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """The ``k`` rows most similar to ``query``, with ``score``; then those of at least ``threshold``."""
    rows = docs if where is None else docs.filter(where)
    top = rows.withColumn("score", cosine_to(query)(F.col(vector_col))).orderBy(F.desc("score"), F.col(id_col)).limit(k)
    return top if threshold is None else top.filter(F.col("score") >= threshold)


def dense_multi(docs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", blocks: int = 1) -> DataFrame:
    """The ``k`` most similar rows for each query; queries are cut into ``blocks`` by their ids, each broadcast by itself."""
    asked = queries.select(query_id, query_vector)
    if blocks > 1:
        parts = [dense_multi(docs, asked.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b), k, id_col=id_col, vector_col=vector_col, query_id=query_id, query_vector=query_vector) for b in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    # The block's queries as one matrix: at most ``QUERY_BLOCK`` vectors, so what every task is sent is bounded.
    rows = asked.limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries in one block: raise ``blocks``")
    if not rows:
        return docs.drop(vector_col).withColumn(query_id, F.lit(None).cast(queries.schema[query_id].dataType)).withColumns({"score": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    size = max(len(r[1] or ()) for r in rows)
    matrix = _stacked([r[1] for r in rows], size)

    @F.pandas_udf("array<struct<query:int,score:double>>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            here = _stacked(column, size)
            both = matrix @ here.T
            # Only a batch's own k best of each query can be among the k best of all; ties at the edge stay.
            keep = both >= np.partition(both, -k, axis=1)[:, [-k]] - 1e-9 if len(column) > k else np.ones_like(both, bool)
            found: list[list] = [[] for _ in range(len(column))]
            for q, d in zip(*np.nonzero(keep)):
                found[d].append({"query": int(q), "score": float(both[q, d])})
            yield pd.Series(found)

    hit = docs.withColumn("__hit", F.explode(scores(F.col(vector_col)))).drop(vector_col)
    names = F.broadcast(docs.sparkSession.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], T.StructType([T.StructField("__n", T.IntegerType()), queries.schema[query_id]])))
    scored = hit.select(*[c for c in hit.columns if c != "__hit"], F.col("__hit.query").alias("__n"), F.col("__hit.score").alias("score")).join(names, "__n").drop("__n")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), F.col(id_col)))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _stacked(vectors, size: int) -> np.ndarray:
    """Vectors as rows of length 1; nulls and zero vectors as zeros, longer or shorter ones cut or filled up."""
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors):
        if v is not None:
            n = min(len(v), size)
            row[:n] = v[:n]
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms == 0, 1, norms)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, term, tf): how often each document holds each term."""
    return docs.select(id_col, F.explode(text_.tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, dl): each document's number of terms."""
    return docs.select(id_col, F.size(text_.tokens(F.col(text_col))).cast("long").alias("dl"))


def term_df(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    distinct = docs.select(F.explode(F.array_distinct(text_.tokens(F.col(text_col)))).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(text_.TOKEN, query.lower())))


def bm25(docs: DataFrame, query: str, *, id_col: str = "id", text_col: str = "content", where: Column | None = None, k1: float = values.BM25_K1, b: float = values.BM25_B, stats: DataFrame | None = None) -> DataFrame:
    """(id, score) of every row that holds a query term and passes ``where``.

    The terms of a query are few, so each document's counts come from one pass
    over its own tokens, with no postings exchange; document frequencies and the
    mean length are one partial aggregate to a single row.  Statistics are those
    of ``stats`` (by default of all of ``docs``), whatever ``where`` keeps.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)

    def times(term: str) -> Column:
        return F.size(F.filter(F.col("__own"), lambda t: t == term))

    def counted(df: DataFrame) -> DataFrame:
        # Each step is its own projection, so that a text is tokenised once.
        cut = df.withColumn("__toks", text_.tokens(F.col(text_col)))
        cut = cut.withColumn("__n", F.size("__toks")).withColumn("__own", F.filter("__toks", lambda t: t.isin(terms)))
        return cut.drop("__toks").withColumn("__tf", F.array(*[times(w) for w in terms]))

    corpus = counted(docs if stats is None else stats)
    totals = corpus.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__avg"), F.array(*[F.sum((F.col("__tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("__df"))
    rows = counted(docs if where is None else docs.filter(where)).filter(F.size("__own") > 0).crossJoin(F.broadcast(totals))  # one row
    score = sum(
        (
            F.log(1 + (F.col("__docs") - F.col("__df")[i] + 0.5) / (F.col("__df")[i] + 0.5))
            * F.col("__tf")[i] * (k1 + 1)
            / (F.col("__tf")[i] + k1 * (1 - b + b * F.col("__n") / F.col("__avg")))
            for i in range(len(terms))
        ),
        F.lit(0.0),
    )
    return rows.select(id_col, score.alias("score"))


def kept_terms(weights: dict[str, float], drop_ratio: float) -> list[str]:
    """The query's terms without the share ``drop_ratio`` of those with the least weight (at least one stays)."""
    order = sorted(weights, key=lambda t: (weights[t], t))
    return order[min(int(drop_ratio * len(order)), len(order) - 1) :] if order else []


def bm25_stored(postings: DataFrame, totals: tuple[int, int], query: str, *, docs: DataFrame | None = None, where: Column | None = None, k1: float = values.BM25_K1, b: float = values.BM25_B, drop_ratio: float = 0.0) -> DataFrame:
    """(id, score) like ``bm25``, from a stored index: reads the postings of the query's terms and no text.

    ``totals`` are the collection's rows and terms.  With ``where`` only rows of
    ``docs`` that pass it are scored; statistics are those of the whole collection.
    """
    n, terms = totals
    found = postings.filter(F.col("term").isin(query_terms(query) or [""]))
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row for each query term
    weight = {t: math.log(1 + (n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    kept = kept_terms(weight, drop_ratio)
    if not kept:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    idf = F.create_map(*[F.lit(x) for t in kept for x in (t, weight[t])])[F.col("term")]
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (terms / n)))
    rows = found.filter(F.col("term").isin(kept)).select("id", part.alias("part"))
    if where is not None:
        rows = rows.join(docs.filter(where).select("id"), "id", "left_semi")
    return rows.groupBy("id").agg(F.sum("part").alias("score"))


@dataclass
class Pruned:
    """How much of an index a pruned search looked at."""

    spans: int = 0  # that hold a query term
    read: int = 0


def bm25_pruned(blocks: DataFrame, totals: tuple[int, int], query: str, k: int, *, gone: DataFrame | None = None, only: DataFrame | None = None, k1: float = values.BM25_K1, b: float = values.BM25_B, drop_ratio: float = 0.0, first: int = 8, told: Pruned | None = None, tie: Column | None = None) -> DataFrame:
    """The ``k`` best (id, score) of ``bm25_stored``, from blocks of postings, most of which are never read.

    A span's rows can't score more than its blocks' largest tf and smallest dl
    allow.  The ``first`` most promising spans are scored; of the others only those
    are read that could still reach the k-th best score so far.  ``gone`` are
    deleted rows (part, id), ``only`` the ids that may be found; ties go by ``tie``
    (the id).
    """
    told = Pruned() if told is None else told
    n, terms = totals
    asked = blocks.filter(F.col("term").isin(query_terms(query) or [""]))
    df = {r["term"]: r["df"] for r in asked.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # one row for each query term
    if gone is not None and df:
        held = asked.join(F.broadcast(gone.select("part").distinct()), "part", "left_semi").select("term", "part", F.inline("rows"))  # names of parts
        for r in held.join(gone, ["part", "id"], "left_semi").groupBy("term").agg(F.count("*").alias("lost")).collect():
            df[r["term"]] -= r["lost"]
    weight = {t: math.log(1 + (n - x + 0.5) / (x + 0.5)) for t, x in df.items() if x}
    kept = kept_terms(weight, drop_ratio)
    if not kept:
        return blocks.select(F.lit("").alias("id"), F.lit(0.0).alias("score")).limit(0)
    idf = F.create_map(*[F.lit(x) for t in kept for x in (t, weight[t])])[F.col("term")]

    def share(tf: str, dl: str) -> Column:
        return idf * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / (terms / n)))

    asked = blocks.filter(F.col("term").isin(kept))
    bounds = asked.select("part", "span", share("max_tf", "min_dl").alias("most")).groupBy("part", "span").agg(F.sum("most").alias("most"))
    told.spans = bounds.count()

    def scores(spans: DataFrame | list) -> DataFrame:
        mine = asked
        if not isinstance(spans, DataFrame):
            mine = mine.filter(F.col("span").isin([r["span"] for r in spans]))
            spans = F.broadcast(blocks.sparkSession.createDataFrame([(r["part"], r["span"]) for r in spans], "part string, span long"))
        rows = mine.join(spans.select("part", "span"), ["part", "span"], "left_semi").select("term", "part", F.inline("rows"))
        rows = rows if gone is None else rows.join(gone, ["part", "id"], "left_anti")
        rows = rows if only is None else rows.join(only.select("id"), "id", "left_semi")
        return rows.select("id", share("tf", "dl").alias("share")).groupBy("id").agg(F.sum("share").alias("score"))

    best = bounds.orderBy(F.desc("most"), "part", "span").limit(max(first, k // 8)).collect()
    reached = scores(best).orderBy(F.desc("score")).limit(k).collect()
    told.read = len(best)
    everything = scores(best)
    if told.read < told.spans:
        least = reached[-1]["score"] * (1 - 1e-9) if len(reached) == k else 0.0
        done = F.broadcast(blocks.sparkSession.createDataFrame([(r["part"], r["span"]) for r in best], "part string, span long"))
        rest = bounds.filter(F.col("most") >= least).join(done, ["part", "span"], "left_anti")
        few = rest.limit(QUERY_BLOCK + 1).collect()
        told.read += len(few) if len(few) <= QUERY_BLOCK else rest.count()
        if few:
            everything = everything.unionByName(scores(few if len(few) <= QUERY_BLOCK else rest))
    return everything.orderBy(F.desc(F.round("score", 9)), F.col("id") if tie is None else tie).limit(k)


def bm25_topk(docs: DataFrame, query: str, k: int, *, id_col: str = "id", **options) -> DataFrame:
    return bm25(docs, query, id_col=id_col, **options).orderBy(F.desc("score"), F.col(id_col)).limit(k)


def ranked(leg: DataFrame, id_col: str = "id") -> DataFrame:
    """A leg's rows, at most a few hundred, with their rank from 1."""
    return leg.select(id_col, "score", F.row_number().over(Window.orderBy(F.desc("score"), F.col(id_col))).alias("rank"))


def rrf(legs: Sequence[DataFrame], k: int, *, id_col: str = "id", rank_constant: int = values.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of legs that are already limited: (id, score)."""
    parts = [ranked(leg, id_col).select(id_col, (F.lit(1.0) / (F.col("rank") + rank_constant)).alias("part")) for leg in legs]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(id_col).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), F.col(id_col)).limit(k)


def weighted(legs: Sequence[DataFrame], weights: Sequence[float], k: int, *, id_col: str = "id") -> DataFrame:
    """Weighted sum of each leg's scores, scaled to 0..1 within the leg."""
    both = None
    for leg, weight in zip(legs, weights, strict=True):
        whole = Window.partitionBy()
        low, high = F.min("score").over(whole), F.max("score").over(whole)
        part = leg.select(id_col, (F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))) * weight).alias("part"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(id_col).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), F.col(id_col)).limit(k)


def hybrid(docs: DataFrame, query: str, query_vector: Sequence[float], k: int, *, id_col: str = "id", text_col: str = "content", vector_col: str = "vector", where: Column | None = None, rerank: str = "rrf", weights: Sequence[float] = (0.5, 0.5), rank_constant: int = values.RRF_K, index: tuple[DataFrame, tuple[int, int], DataFrame | None] | None = None, drop_ratio: float = 0.0, dense: DataFrame | None = None) -> DataFrame:
    """Dense and full-text legs of ``k`` rows each, both filtered first, fused to ``k`` rows.

    ``index`` are a collection's blocks of postings, its totals and its deleted
    rows; without it texts are read.  ``dense`` is that leg where it is known already.
    """
    if index is None:
        sparse = bm25_topk(docs, query, k, id_col=id_col, text_col=text_col, where=where)
    else:
        blocks, totals, gone = index
        sparse = bm25_pruned(blocks, totals, query, k, gone=gone, only=None if where is None else docs.filter(where), drop_ratio=drop_ratio)
    dense = dense_topk(docs, query_vector, k, id_col=id_col, vector_col=vector_col, where=where) if dense is None else dense
    legs = [dense.select(id_col, "score"), sparse]
    return rrf(legs, k, id_col=id_col, rank_constant=rank_constant) if rerank == "rrf" else weighted(legs, weights, k, id_col=id_col)


def fetched(top: DataFrame, docs: DataFrame, *, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The few rows of ``top`` as a table at hand, and those of ``docs`` with their ids, by a filter that the scan can use."""
    found = top.select(id_col, "score").collect()  # at most k rows
    few = docs.sparkSession.createDataFrame(found, top.select(id_col, "score").schema)
    return few, docs.filter(any_of(id_col, [r[0] for r in found]))


def as_results(fused: DataFrame, docs: DataFrame, *, id_col: str = "id") -> DataFrame:
    """The public columns of search results: content, relative_path, start_line, end_line, language, score."""
    few, rows = fetched(fused, docs, id_col=id_col)
    return rows.join(F.broadcast(few), id_col).select("content", "relative_path", "start_line", "end_line", "language", "score").orderBy(F.desc("score"), "relative_path", "start_line")
