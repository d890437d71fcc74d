"""Every catalogue query against its SQL, on the smallest tables."""

import duckdb
import pytest

from sablewick.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v) if hasattr(v, "isoformat") else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    want_columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(want_columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want_columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dense_multi_in_blocks(spark, sf_dir):
    """Blocks of queries give what one block gives, and what a plain cross product gives."""
    from pyspark.sql import functions as F

    from sablewick.functions.vectors import cosine
    from sablewick.operators import search

    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    asked = docs.filter("vec_id % 10 = 0 OR vec_id = -2").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    one, many = (search.dense_multi(docs, asked, 3, id_col="vec_id", vector_col="embedding", blocks=n).collect() for n in (1, 3))
    plain = sorted((r["query_id"], r["rank"], round(r["score"], 6)) for r in one)
    assert plain == sorted((r["query_id"], r["rank"], round(r["score"], 6)) for r in many) and len(one) == 3 * asked.count() > 0
    pairs = docs.crossJoin(asked).withColumn("s", F.coalesce(cosine(F.col("embedding"), F.col("query_vector")), F.lit(0.0)))
    best = {r["query_id"]: round(r["s"], 6) for r in pairs.groupBy("query_id").agg(F.max("s").alias("s")).collect()}
    assert {q: s for q, rank, s in plain if rank == 1} == best
    assert search.dense_multi(docs, asked.limit(0), 3, id_col="vec_id", vector_col="embedding").count() == 0


def test_searches_read_no_text(spark, sf_dir):
    """Full-text scores come from the stored postings, with the terms pushed into the scan."""
    catalogue.QUERIES["bm25_topk"](spark, sf_dir)  # builds the collection
    plan = catalogue.QUERIES["bm25_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "regexp" not in plan and "PushedFilters: [In(term" in plan


def test_cap_ranks_keys_only(spark, sf_dir):
    from sablewick.operators import split

    rows = spark.range(50).selectExpr("concat('f', id % 7) AS relative_path", "int(id) AS pos", "repeat('x', 9) AS content")
    got, outcome = split.capped(rows, 20)
    want = sorted((r["relative_path"], r["pos"]) for r in rows.collect())[:20]
    assert outcome == "limit_reached" and sorted((r["relative_path"], r["pos"]) for r in got.collect()) == want
    assert split.capped(rows, 50)[1] == "completed"


def test_resume_compares_at_any_size(spark, tmp_path):
    spark.range(1000).selectExpr("id AS doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(900).selectExpr("id AS doc_id").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(r[0] for r in catalogue.QUERIES["resume_remaining"](spark, str(tmp_path)).collect()) == list(range(900, 1000))
