"""The SQL functions."""

from sablewick.plans import sql


def test_functions(spark):
    sql.register(spark)
    spark.createDataFrame([("a/b.py", "def f():\n    pass\n\ndef g():\n    pass\n")], "path string, content string").createOrReplaceTempView("files")
    rows = spark.sql("SELECT f.path, s.* FROM (SELECT path, content, path_language(path) AS language FROM files) f, LATERAL split_code(f.content, f.language) s ORDER BY s.pos").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 2), (2, 5)]  # the second begins with the overlap
    one = spark.sql("SELECT cosine(embed_text(content), embed_text(content)) AS same, cosine(array(0D), array(1D)) AS none, chunk_id('a.py', 1, 2, 'x') AS id, path_extension('x/.env') AS e, path_language('q.rs') AS l FROM files").first()
    assert abs(one["same"] - 1) < 1e-6 and one["none"] == 0 and one["id"] == "chunk_6dec083070b725c8" and one["e"] == "" and one["l"] == "rust"
