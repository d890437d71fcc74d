"""Connected components of a distributed edge list, by alternating star contractions.

Each round replaces every vertex's edges by edges to its smallest neighbour,
first for its larger neighbours (large star), then for its smaller ones (small
star).  Rounds are logarithmic in practice; edges never grow in number.  A hub's
edges are pre-aggregated to one minimum and joined on an image of the vertex, so
that a vertex with very many edges is split over tasks.  Each round is written
to the shared folder; only whether all is settled reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewick.llm import common

MOST_ROUNDS = 60


def _image(vertex: Column) -> Column:
    return F.concat(F.lit(b"="), vertex)


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction of edges (u, v) with u > v, returned in the same form."""
    if larger:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(_image(F.col("u")).alias("k"), F.col("u").alias("c"), F.least("u", "m").alias("m"))
    both = around.withColumn("k", _image(F.col("u"))).join(least, "k")
    if larger:
        return both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    # The vertex itself joins its smallest neighbour, and so do the others.
    moved = both.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex that is not its component's smallest; ``edges`` has binary columns u and v."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = common.written(now, "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            return now.select("u", F.col("v").alias("root"))
        now = common.written(_star(_star(now, True), False), "edges")
    raise RuntimeError("components did not settle")


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one edge and none leads to a vertex that has one."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.select(_image(F.col("v")).alias("k")).join(edges.select(_image(F.col("u")).alias("k")), "k", "left_semi").isEmpty()
