"""The stored vector index against brute force."""

import re
import uuid

import numpy as np
import pytest

from sablewick.operators import ann, search

SCHEMA = "id long, vector array<float>"


def clustered(n: int, seed: int = 1, dimension: int = 16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dimension))
    return [(i, (centres[i % 20] + 0.2 * r.normal(size=dimension)).astype(np.float32).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("vectors"))


def asked_of(df, every: int):
    return df.filter(f"id % {every} = 0 AND id >= 0").selectExpr("id AS query_id", "vector AS query_vector")


def test_finds_neighbours_in_few_cells(spark, folder):
    df = spark.createDataFrame(clustered(4000), SCHEMA).repartition(4)
    index = ann.VectorIndex.build(df, f"{folder}/{uuid.uuid4().hex}")
    model = index.model()
    assert len(model.centres) == 63 and model.probe <= len(model.centres) // 3
    asked = asked_of(df, 100)
    exact = search.dense_multi(df, asked, 10).select("query_id", "id")
    n, found = ann.recall(index.search(asked, 10), exact).first()
    assert n == 400 and found >= 0.9 * n
    assert ann.recall(ann.in_blocks(index, asked, 10, 3), exact).first()["found"] == found
    whole = index.search(asked, 10, probe=63, shortlist=400)  # everything is read and ranked: the exact result
    assert ann.recall(whole, exact).first()["found"] == n


def test_scan_is_pruned(spark, folder):
    df = spark.createDataFrame(clustered(2000), SCHEMA)
    index = ann.VectorIndex.build(df, f"{folder}/{uuid.uuid4().hex}")
    found = index.search(asked_of(df, 2000), 5, probe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[cell#\d+ IN \(\d+,\d+\)\]", plan)


def test_awkward_vectors(spark, folder):
    """Vectors without a direction are stored but never found; equal ones come by id; a query without a direction finds nothing."""
    rows = clustered(300) + [(-1, None), (-2, [0.0] * 16), (-3, [1.0]), (-4, []), (-5, [float("nan")] * 16), (-6, [None] * 16)]
    rows += [(1000 + i, [2.0] + [0.0] * 15) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = ann.VectorIndex.build(df, f"{folder}/{uuid.uuid4().hex}")
    assert index.rows().count() == len(rows) and index.rows().filter("cell = -1").count() == 6
    asked = spark.createDataFrame([(1, [3.0] + [0.0] * 15), (2, None), (3, [0.0] * 16)], "query_id long, query_vector array<float>")
    got = index.search(asked, 7).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], round(r["score"], 6)) for r in got] == [(1, 1000 + i, 1.0) for i in range(7)]


def test_further_rows_and_none(spark, folder):
    df = spark.createDataFrame(clustered(500), SCHEMA)
    index = ann.VectorIndex.build(df, f"{folder}/{uuid.uuid4().hex}")
    index.add(spark.createDataFrame([(9000, clustered(1)[0][1])], SCHEMA))
    got = index.search(asked_of(df, 500), 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 9000]
    empty = ann.VectorIndex.build(spark.createDataFrame([], SCHEMA), f"{folder}/{uuid.uuid4().hex}")
    assert empty.exists() and empty.search(spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<float>"), 3).collect() == []
    with pytest.raises(ValueError):
        index.search(spark.range(ann.QUERY_BLOCK + 5).selectExpr("id AS query_id", "array(1.0f) AS query_vector"), 3)


def test_collection_with_index(spark, tmp_path):
    """Rows added later are found, deleted ones aren't, and a filter comes before the ranking."""
    from pyspark.sql import functions as F

    from sablewick.sources.store import CHUNK_SCHEMA, Store

    s = Store(spark, str(tmp_path))
    s.create("c", 16, hybrid=False)
    rows = lambda some: spark.createDataFrame([(str(i), v, "text", f"{i % 7}.py", 1, 1, ".py", "{}") for i, v in some], CHUNK_SCHEMA)
    own = clustered(2000)
    s.insert("c", rows(own))
    ann.index_collection(s, "c")
    query = own[40][1]
    found = lambda **o: [r["id"] for r in ann.dense_stored(s, "c", query, 5, **o).collect()]
    exact = lambda **o: [r["id"] for r in search.dense_topk(s.read("c"), query, 5, **o).collect()]
    assert found()[0] == "40" and len(set(found()) & set(exact())) >= 4
    s.insert("c", rows([(9000, query)]))
    s.delete("c", [exact()[2]])
    assert set(found()[:2]) == {"40", "9000"} and found() == [x for x in found() if x in {r["id"] for r in s.read("c").select("id").collect()}]
    where = F.col("relative_path") == "3.py"
    assert found(where=where) == exact(where=where)
    s.delete("c", ["40"])
    s.compact("c", share=0.0)  # the indexed part is gone: the whole collection is read
    assert found() == exact()
    s.vacuum("c")
    assert found() == exact()
