"""Hand-derived cases of names, paths, text, vectors, filters and search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablewick.functions import ids, paths
from sablewick.functions import text as text_
from sablewick.functions.embed import HashEmbedder, RemoteEmbedder, embedder
from sablewick.functions.vectors import cosine, cosine_to
from sablewick.operators import search
from sablewick.plans.filters import FilterError, parse_filter


def values_of(spark, expr, inputs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").orderBy("i").select(expr).collect()]


def test_chunk_id(spark):
    row = spark.range(1).select(ids.chunk_id(F.lit("a.py"), F.lit(1), F.lit(2), F.lit("x")).alias("c")).first()
    assert row["c"] == "chunk_6dec083070b725c8"


def test_extension_and_language(spark):
    assert values_of(spark, paths.extension(F.col("x")), ["a/b.c.py", ".env", "x/.env", "Makefile", "a."]) == [".py", "", "", "", "."]
    assert values_of(spark, paths.language(F.col("x")), ["a.tsx", "a.h", "a.hpp", "a.md", "a.ipynb"]) == ["typescript", "c", "cpp", "text", "jupyter"]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*.min.js", "lib/x.min.js", True),
        ("*.min.js", "lib/x.js", False),
        ("docs/", "a/docs/x.md", True),
        ("node_modules", "a/node_modules/x.js", True),
        ("node_modules/**", "node_modules/x.js", True),
        ("node_modules/**", "a/node_modules/x.js", False),
        ("/build", "build/x.js", True),
        ("a?c", "abc", False),
        ("src/gen", "src/gen/x.py", True),
        ("src/gen", "src/general/x.py", False),
        ("", "x", False),
    ],
)
def test_ignore(spark, pattern, path, hit):
    assert values_of(spark, paths.ignored(F.col("x"), [pattern]), [path]) == [hit]


def test_ignore_files_and_extensions():
    assert paths.parse_ignore_file("# c\n\n  dist  \n!keep.py") == ["dist", "!keep.py"]
    assert paths.extensions_from_env(" py, .ts ,,py") == [".py", ".ts"]
    assert paths.check_extension_filter([".ts", " .py "]) == [".ts", ".py"]
    for wrong in (["ts"], [".a b"], ["."], [3]):
        with pytest.raises(ValueError):
            paths.check_extension_filter(wrong)


def test_text(spark):
    assert values_of(spark, text_.trim_all(F.col("x")), ["\n\t a \u00a0\n", ""]) == ["a", ""]
    assert values_of(spark, text_.truncated(F.col("x"), 5), ["abcdef", "abcde"]) == ["abcde...", "abcde"]
    assert values_of(spark, text_.start_line(F.lit("a\nb\nc"), F.col("x")), ["c", "a", "zz", "b\nc"]) == [3, 1, 1, 2]
    assert values_of(spark, text_.line_window(F.col("x"), 1, 1), ["a\nb\nc"]) == ["b"]
    assert values_of(spark, text_.line_window(F.col("x"), 1, None), ["a\nb\nc"]) == ["a\nb\nc"]


def test_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],), ([1.0],), (None,)], "v array<float>")
    q = [1.0, 0.0]
    got = [r[0] for r in df.select(cosine_to(q)(F.col("v"))).collect()]
    assert np.allclose(got, [0, 2**-0.5, 1, 0])
    assert np.allclose([r[0] for r in df.limit(2).select(cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0)))).collect()], [0, 2**-0.5])


def test_embedders():
    e = HashEmbedder(16)
    v = np.array(e.embed("alpha beta alpha"))
    assert v.shape == (16,) and np.isclose((v * v).sum(), 1) and e.detect_dimension() == 16
    assert not np.any(e.embed(""))
    remote = embedder("Gemini", fetch=lambda texts, model: [[1.0] * 3072 for _ in texts], dimension=768)
    assert len(remote.embed("x" * 100_000)) == 768 and remote.prepared("") == " "
    assert len(remote.prepared("x" * 100_000)) == 2048 * 4
    with pytest.raises(ValueError):
        RemoteEmbedder("Gemini", None, dimension=5)
    with pytest.raises(ValueError):
        embedder("nobody")


def test_rrf(spark):
    leg = lambda names: spark.createDataFrame([(n, float(-i)) for i, n in enumerate(names)], "id string, score double")
    got = [(r["id"], round(r["score"], 6)) for r in search.rrf([leg("ABC"), leg("BD")], 3).collect()]
    assert got == [("B", 0.019705), ("A", 0.009901), ("D", 0.009804)]
    assert got == [(r["id"], round(r["score"], 6)) for r in search.rrf([leg("BD"), leg("ABC")], 3).collect()]


def test_filters(spark):
    df = spark.createDataFrame([("a.py", ".py", 1), ("b.ts", ".ts", 5), ("c'd.ts", ".ts", 9)], "relative_path string, file_extension string, start_line long")
    ask = lambda text: [r[0] for r in df.filter(parse_filter(text)).orderBy("relative_path").select("relative_path").collect()]
    assert ask("fileExtension in ['.ts']") == ["b.ts", "c'd.ts"]
    assert ask("fileExtension not in ['.ts'] or startLine >= 9") == ["a.py", "c'd.ts"]
    assert ask("!(startLine < 5) && relativePath != \"b.ts\"") == ["c'd.ts"]
    assert ask("relativePath == 'c\\'d.ts'") == ["c'd.ts"] and ask("relativePath like 'a%'") == ["a.py"]
    assert parse_filter("  ") is None
    for wrong in ("x in", "x ==", "(x == 1", "x == 1 y", "1 == x", "x ~ 3"):
        with pytest.raises(FilterError):
            parse_filter(wrong)


def test_bm25_without_terms(spark):
    df = spark.createDataFrame([("a", "x y")], "id string, content string")
    assert search.bm25(df, "!!").count() == 0 and search.bm25(df, "zzz").count() == 0


def test_dense_filters_before_ranking(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(10)], "id int, vector array<float>, odd int")
    got = [r["id"] for r in search.dense_topk(df, [1.0, 0.0], 2, where=parse_filter("odd == 1")).collect()]
    assert got == [1, 3]
