"""The engine's functions for SQL: table and vectorised functions by name.

``register`` adds to a session

* ``split_code(content, language)``: a table function, one row per chunk
  (``SELECT * FROM files, LATERAL split_code(content, language)``);
* ``embed_text(content)``: the embedder as array<float>;
* ``path_language(path)`` and ``path_extension(path)``;
* ``cosine(a, b)``, ``chunk_id(path, first, last, content)``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sablewick.functions.embed import Embedder, HashEmbedder
from sablewick.operators.split import Splitter

COSINE = """CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
  coalesce(aggregate(zip_with(a, b, (x, y) -> coalesce(x * y, 0D)), 0D, (s, x) -> s + x)
    / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D)"""
CHUNK_ID = """CREATE OR REPLACE TEMPORARY FUNCTION chunk_id(path STRING, first BIGINT, last BIGINT, content STRING) RETURNS STRING RETURN
  concat('chunk_', substring(sha2(concat_ws(':', path, first, last, content), 256), 1, 16))"""
EXTENSION = r"""CREATE OR REPLACE TEMPORARY FUNCTION path_extension(path STRING) RETURNS STRING RETURN
  regexp_extract(path, r'(?<=[^/])(\.[^./]*)$', 1)"""


def register(spark: SparkSession, splitter: Splitter | None = None, embedder: Embedder | None = None) -> None:
    chosen, model = splitter or Splitter(), embedder or HashEmbedder()

    class SplitCode:
        def eval(self, content: str, language: str) -> Iterator[tuple]:
            for pos, c in enumerate(chosen.split(content or "", language)):
                yield pos, c.content, c.start_line, c.end_line

    spark.udtf.register("split_code", F.udtf(SplitCode, returnType="pos int, chunk string, start_line int, end_line int"))
    spark.udf.register("embed_text", model.column())
    for statement in (COSINE, CHUNK_ID, EXTENSION):
        spark.sql(statement)
    known = ", ".join(f"'{e}', '{n}'" for e, n in _languages())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION path_language(path STRING) RETURNS STRING RETURN coalesce(try_element_at(map({known}), path_extension(path)), 'text')")


def _languages():
    from sablewick.functions import values

    return values.LANGUAGES.items()
