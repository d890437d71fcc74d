"""Registered queries over the driver's tables, each with the SQL that states its result.

``code_files`` is a view of ``documents`` as source files: the path is made of
source, language and id, and the extension follows the language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablewick.functions import ids, paths, values
from sablewick.functions import text as text_
from sablewick.functions.embed import HashEmbedder
from sablewick.functions.vectors import cosine, cosine_to
from sablewick.operators import ann, evaluate, search, split, sync
from sablewick.plans.filters import parse_filter
from sablewick.sources.state import recent
from sablewick.sources.store import LENGTHS, Files, Store, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DIM = 64
QUESTION = "the tion are with"
TERMS = search.query_terms(QUESTION)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Limits of a collection that holds whole documents as chunks.
WHOLE = {k: v for k, v in LENGTHS.items() if k != "content"}


def collection(spark: SparkSession, sf_dir: str) -> tuple[Store, str]:
    """``code_files`` as a stored collection with vectors and full-text index, built when first asked for and again when the table changes."""
    store = Store(spark, f"{shared_folder(spark)}/catalogue", WHOLE)
    state = store.files.__class__(spark, sf_dir).tree(f"{sf_dir}/documents.parquet")
    name = "documents_" + hashlib.md5(repr(state).encode()).hexdigest()
    if not store.has(name):
        store.create(name, DIM)
    if store.describe(name)["version"] is None:
        fill(store, name, spark, sf_dir)
    return store, name


def fill(store: Store, name: str, spark: SparkSession, sf_dir: str) -> None:
    """Put ``code_files`` with vectors into an empty collection."""
    rows = code_files(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"), HashEmbedder(DIM).column()(F.col("content")).alias("vector"), "content", "relative_path", F.lit(1).cast("long").alias("start_line"),
        text_.line_count(F.col("content")).cast("long").alias("end_line"), paths.extension(F.col("relative_path")).alias("file_extension"), F.to_json(F.struct(F.col("lang").alias("language"))).alias("metadata"),
    )
    store.insert(name, rows)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", ".ts").otherwise(".java")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("relative_path"), F.coalesce("text", F.lit("")).alias("content"), "lang", "source")


FILES_SQL = """code_files AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS content,
         source || '/' || lang || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.ts' ELSE '.java' END AS relative_path
  FROM documents)"""

# ------------------------------------------------------------------ dense search

QV_SQL = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
COS_SQL = "list_cosine_similarity(embedding::DOUBLE[], qv)"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row["embedding"]]


def _scored(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("score", 6).alias("score"))


@query(f"WITH {QV_SQL} SELECT vec_id, label, round({COS_SQL}, 6) AS score FROM embeddings, q ORDER BY {COS_SQL} DESC, vec_id LIMIT 10")
def dense_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings")
    return _scored(search.dense_topk(docs, _first_vector(spark, sf_dir), 10, id_col="vec_id", vector_col="embedding"), "vec_id", "label")


@query(f"WITH {QV_SQL} SELECT vec_id, label, round({COS_SQL}, 6) AS score FROM embeddings, q WHERE label IN (1, 2, 3) ORDER BY {COS_SQL} DESC, vec_id LIMIT 10")
def dense_topk_filtered(spark, sf_dir):
    docs, where = table(spark, sf_dir, "embeddings"), parse_filter("label in [1, 2, 3]")
    return _scored(search.dense_topk(docs, _first_vector(spark, sf_dir), 10, id_col="vec_id", vector_col="embedding", where=where), "vec_id", "label")


@query(f"WITH {QV_SQL}, t AS (SELECT vec_id, {COS_SQL} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 20) SELECT vec_id, round(s, 6) AS score FROM t WHERE s >= 0.3")
def dense_threshold(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings")
    return _scored(search.dense_topk(docs, _first_vector(spark, sf_dir), 20, id_col="vec_id", vector_col="embedding", threshold=0.3), "vec_id")


@query("""WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 5""")
def dense_multi_query(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings")
    asked = docs.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    blocks = max(1, -(-2 * asked.count() // search.QUERY_BLOCK))  # half full on average, as ids are dealt by a hash
    top = search.dense_multi(docs.select("vec_id", "embedding"), asked, 5, id_col="vec_id", vector_col="embedding", blocks=blocks)
    return top.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _vector_index(spark: SparkSession, sf_dir: str) -> ann.VectorIndex:
    """All ``embeddings`` in a stored index, built when first asked for and again when the table changes."""
    path = f"{sf_dir}/embeddings.parquet"
    name = hashlib.md5(repr(Files(spark, sf_dir).tree(path)).encode()).hexdigest()
    index = ann.VectorIndex(spark, f"{shared_folder(spark)}/vectors-{name}")
    return index if index.exists() else ann.VectorIndex.build(table(spark, sf_dir, "embeddings"), index.path, id_col="vec_id", vector_col="embedding")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Every hundredth vector as a query, and the number of blocks that these are cut into."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return asked, max(1, -(-2 * asked.count() // search.QUERY_BLOCK))


@query()
def ann_topk(spark, sf_dir):
    """The ten nearest vectors of every hundredth one, from the stored index."""
    asked, blocks = _asked(spark, sf_dir)
    found = ann.in_blocks(_vector_index(spark, sf_dir), asked, 10, blocks)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("""WITH asked AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0)
SELECT (SELECT count(*) FROM asked) * least(10, (SELECT count(*) FROM embeddings)) AS n, true AS recall_reached""")
def ann_recall(spark, sf_dir):
    """Of the exact ten nearest vectors of every hundredth one, at least nine tenths are found by the index."""
    asked, blocks = _asked(spark, sf_dir)
    docs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    exact = search.dense_multi(docs, asked, 10, id_col="vec_id", vector_col="embedding", blocks=blocks).select("query_id", F.col("vec_id").alias("id"))
    found = ann.in_blocks(_vector_index(spark, sf_dir), asked, 10, blocks)
    return ann.recall(found, exact).select("n", (F.col("found") >= 0.9 * F.col("n")).alias("recall_reached"))


@query(f"WITH {QV_SQL} SELECT vec_id, round({COS_SQL}, 6) AS score FROM embeddings, q")
def cosine_all(spark, sf_dir):
    v = F.array(*[F.lit(x) for x in _first_vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), v), 6).alias("score"))


@query(f"""WITH {QV_SQL}, t AS (SELECT label, {COS_SQL} AS s FROM embeddings, q)
SELECT label, count(*) AS n, round(coalesce(avg(s), 0), 6) AS avg_score, round(max(s), 6) AS best FROM t GROUP BY label""")
def avg_score_summary(spark, sf_dir):
    v = F.array(*[F.lit(x) for x in _first_vector(spark, sf_dir)])
    rows = table(spark, sf_dir, "embeddings").select("label", cosine(F.col("embedding"), v).alias("s"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("avg_score"), F.round(F.max("s"), 6).alias("best"))


# ------------------------------------------------------------------ full text

TOKENS_SQL = "toks AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents)"


@query(f"WITH {TOKENS_SQL} SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM toks")
def tokenize_counts(spark, sf_dir):
    t = text_.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS t FROM toks) GROUP BY ALL")
def postings(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {TOKENS_SQL} SELECT lang, count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens, round(avg(len(t)), 6) AS avgdl FROM toks GROUP BY lang")
def doc_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    n = F.size(text_.tokens(F.col("text")))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("avgdl"))


@query(f"WITH {TOKENS_SQL} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM toks) GROUP BY term")
def term_df(spark, sf_dir):
    return search.term_df(table(spark, sf_dir, "documents"), "doc_id", "text")


def _bm25_sql(where: str = "true", k: int | None = None, name: str = "bm25") -> str:
    wanted = ", ".join(f"'{t}'" for t in TERMS)
    top = f" ORDER BY round(score, 9) DESC, doc_id LIMIT {k}" if k else ""
    return f"""{TOKENS_SQL}, n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) WHERE term IN ({wanted}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
{name} AS (SELECT doc_id, score FROM (
  SELECT doc_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS score
  FROM tf JOIN df USING (term) JOIN toks USING (doc_id), n WHERE {where} GROUP BY doc_id){top})"""


def _bm25(spark, sf_dir, **options) -> DataFrame:
    """Scores from the stored full-text index; no text is read."""
    store, name = collection(spark, sf_dir)
    scores = search.bm25_stored(store.postings(name), store.totals(name), QUESTION, **options)
    return scores.select(F.col("id").cast("long").alias("doc_id"), "score")


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_scores(spark, sf_dir):
    return _scored(_bm25(spark, sf_dir), "doc_id")


@query(f"WITH {_bm25_sql(k=10)} SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_topk(spark, sf_dir):
    return _scored(_best(_bm25(spark, sf_dir), 10), "doc_id")


@query(f"WITH {_bm25_sql(k=10)} SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_pruned(spark, sf_dir):
    """The same ranking from the blocks of postings that can hold one of the best rows."""
    store, name = collection(spark, sf_dir)
    top = search.bm25_pruned(store.blocks(name), store.totals(name), QUESTION, 10, tie=F.col("id").cast("long"))
    return top.select(F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(where="lang IN ('fr', 'de')", k=10)} SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_topk_filtered(spark, sf_dir):
    store, name = collection(spark, sf_dir)
    docs = store.read(name).withColumn("lang", F.get_json_object("metadata", "$.language"))
    return _scored(_best(_bm25(spark, sf_dir, docs=docs, where=parse_filter("lang in ['fr', 'de']")), 10), "doc_id")


@query(f"WITH {_bm25_sql(k=10)} SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_unindexed(spark, sf_dir):
    """The same ranking straight from the texts, for collections without an index."""
    return _scored(_best(search.bm25(table(spark, sf_dir, "documents"), QUESTION, id_col="doc_id", text_col="text"), 10), "doc_id")


# ------------------------------------------------------------------ embedding, fusion, hybrid

EMBED_SQL = f"""{TOKENS_SQL},
hashed AS (SELECT doc_id, ('0x' || substr(m, 1, 8))::BIGINT % {DIM} AS k, CASE WHEN ('0x' || substr(m, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s
           FROM (SELECT doc_id, md5(term) AS m FROM (SELECT doc_id, unnest(t) AS term FROM toks))),
weight AS (SELECT doc_id, k, sum(s) AS w FROM hashed GROUP BY ALL),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM weight GROUP BY doc_id),
asked AS (SELECT k, sum(s) AS qw FROM (
  SELECT ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS k, CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s
  FROM (SELECT unnest([{", ".join(repr(t) for t in TERMS)}]) AS term)) GROUP BY k),
asked_norm AS (SELECT sqrt(sum(qw * qw)) AS qn FROM asked),
unit AS (SELECT doc_id, k, (w / n)::FLOAT::DOUBLE AS f FROM weight JOIN norm USING (doc_id) WHERE n > 0),
asked_unit AS (SELECT k, qw / qn AS q FROM asked, asked_norm),
dense AS (SELECT doc_id, coalesce(sum(f * q), 0) / (sqrt(sum(f * f)) * (SELECT sqrt(sum(q * q)) FROM asked_unit)) AS score
          FROM unit LEFT JOIN asked_unit USING (k) GROUP BY doc_id)"""


def _embedded(spark, sf_dir) -> DataFrame:
    return code_files(spark, sf_dir).withColumn("vector", HashEmbedder(DIM).column()(F.col("content")))


@query(f"WITH {EMBED_SQL} SELECT doc_id, k, round((w / n)::FLOAT::DOUBLE, 5) AS weight FROM weight JOIN norm USING (doc_id) WHERE w <> 0")
def hash_embed(spark, sf_dir):
    rows = _embedded(spark, sf_dir).select("doc_id", F.posexplode("vector").alias("k", "x")).filter("x <> 0")
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), F.round(F.col("x").cast("double"), 5).alias("weight"))


def _stored_docs(spark, sf_dir) -> DataFrame:
    store, name = collection(spark, sf_dir)
    return store.read(name).withColumn("doc_id", F.col("id").cast("long"))


def _dense(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.round(cosine_to(HashEmbedder(DIM).embed(QUESTION))(F.col("vector")), 6).alias("score"))


@query(f"WITH {EMBED_SQL} SELECT doc_id, round(score, 6) AS score FROM dense ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def hash_dense_topk(spark, sf_dir):
    return _dense(_stored_docs(spark, sf_dir)).orderBy(F.desc("score"), "doc_id").limit(10)


def _legs(spark, sf_dir, k: int):
    docs = _stored_docs(spark, sf_dir)
    dense = _dense(docs).orderBy(F.desc("score"), "doc_id").limit(k)
    sparse = _bm25(spark, sf_dir).select("doc_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return docs, dense, sparse


def _rrf_sql(k: int) -> str:
    return f"""{EMBED_SQL}, {_bm25_sql(k=k, name='sparse').replace(TOKENS_SQL + ', ', '')},
d AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r, round(score, 6) AS score FROM dense QUALIFY r <= {k}),
s AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r, round(score, 9) AS score FROM sparse),
fused AS (SELECT doc_id, sum(1.0::DOUBLE / (100 + r)) AS score FROM (SELECT doc_id, r FROM d UNION ALL SELECT doc_id, r FROM s) GROUP BY doc_id)"""


@query(f"WITH {_rrf_sql(20)} SELECT doc_id, round(score, 6) AS score FROM fused ORDER BY round(score, 12) DESC, doc_id LIMIT 20")
def rrf_fusion(spark, sf_dir):
    _, dense, sparse = _legs(spark, sf_dir, 20)
    return _scored(search.rrf([dense, sparse], 20, id_col="doc_id"), "doc_id")


@query(f"""WITH {_rrf_sql(20)},
scaled AS (
  SELECT doc_id, 0.7 * CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS p FROM d
  UNION ALL
  SELECT doc_id, 0.3 * CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END FROM s)
SELECT doc_id, round(sum(p)::DOUBLE, 5) AS score FROM scaled GROUP BY doc_id ORDER BY round(sum(p)::DOUBLE, 9) DESC, doc_id LIMIT 10""")
def weighted_fusion(spark, sf_dir):
    _, dense, sparse = _legs(spark, sf_dir, 20)
    return search.weighted([dense, sparse], [0.7, 0.3], 10, id_col="doc_id").select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {_rrf_sql(10)}, {FILES_SQL},
top AS (SELECT doc_id, score FROM fused ORDER BY round(score, 12) DESC, doc_id LIMIT 10)
SELECT content, relative_path, 1::BIGINT AS start_line, len(string_split(content, chr(10)))::BIGINT AS end_line,
       CASE regexp_extract(relative_path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' ELSE 'text' END AS language,
       round(score, 6) AS score
FROM top JOIN code_files USING (doc_id)""")
def hybrid_search(spark, sf_dir):
    docs, dense, sparse = _legs(spark, sf_dir, 10)
    top = search.rrf([dense, sparse], 10, id_col="doc_id")
    shown = docs.select("id", "content", "relative_path", "start_line", "end_line", paths.language(F.col("relative_path")).alias("language"))
    return search.as_results(top.select(F.col("doc_id").cast("string").alias("id"), "score"), shown).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------ paths, ids, projections


@query(f"WITH {FILES_SQL} SELECT relative_path FROM code_files WHERE regexp_extract(relative_path, '[.][a-z]+$') IN ('.ts', '.py')")
def ext_filter(spark, sf_dir):
    wanted = paths.check_extension_filter([".ts", " .py "])
    return code_files(spark, sf_dir).filter(paths.extension(F.col("relative_path")).isin(wanted)).select("relative_path")


@query(f"""WITH {FILES_SQL} SELECT language, count(*) AS n FROM (
  SELECT CASE regexp_extract(relative_path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' ELSE 'text' END AS language FROM code_files) GROUP BY language""")
def lang_map(spark, sf_dir):
    return code_files(spark, sf_dir).groupBy(paths.language(F.col("relative_path")).alias("language")).agg(F.count("*").alias("n"))


@query(f"WITH {FILES_SQL} SELECT relative_path FROM code_files WHERE NOT regexp_matches(relative_path, '(^|/)[^/]*7[.]md(/|$)') AND NOT regexp_matches(relative_path, '(^|/)de(/|$)')")
def ignore_glob(spark, sf_dir):
    return code_files(spark, sf_dir).filter(~paths.ignored(F.col("relative_path"), ["*7.md", "de/"])).select("relative_path")


@query(f"WITH {FILES_SQL} SELECT relative_path FROM code_files WHERE relative_path NOT LIKE 'src1/%' AND NOT (relative_path LIKE 'src2/fr/%' OR relative_path = 'src2/fr')")
def prefix_ignore(spark, sf_dir):
    return code_files(spark, sf_dir).filter(~paths.ignored(F.col("relative_path"), ["/src1", "src2/fr"])).select("relative_path")


@query(f"""WITH {FILES_SQL} SELECT relative_path, regexp_extract(relative_path, '[.][a-z]+$') AS file_extension FROM code_files
WHERE regexp_extract(relative_path, '[.][a-z]+$') IN ({", ".join(repr(e) for e in values.EXTENSIONS)})""")
def indexable_files(spark, sf_dir):
    rows = code_files(spark, sf_dir).filter(paths.indexable(F.col("relative_path")))
    return rows.select("relative_path", paths.extension(F.col("relative_path")).alias("file_extension"))


@query(f"""WITH {FILES_SQL} SELECT relative_path,
  'chunk_' || substr(sha256(relative_path || ':1:' || len(string_split(content, chr(10))) || ':' || content), 1, 16) AS id FROM code_files""")
def chunk_id(spark, sf_dir):
    rows = code_files(spark, sf_dir)
    return rows.select("relative_path", ids.chunk_id(F.col("relative_path"), F.lit(1), text_.line_count(F.col("content")), F.col("content")).alias("id"))


@query("""SELECT DISTINCT source, 'hybrid_code_chunks_' || substr(md5('/' || source), 1, 8) AS hybrid_name, 'code_chunks_' || substr(md5('/' || source), 1, 8) AS dense_name,
  md5('/' || source) AS snapshot_key, 'chrome_repo_' || regexp_replace('own/' || source, '[^a-zA-Z0-9]', '_', 'g') AS repo_name FROM documents""")
def collection_name(spark, sf_dir):
    path = F.concat(F.lit("/"), "source")
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        "source", ids.collection_name(path).alias("hybrid_name"), ids.collection_name(path, False).alias("dense_name"), ids.snapshot_key(path).alias("snapshot_key"), ids.repo_collection(F.concat(F.lit("own/"), "source")).alias("repo_name")
    )


@query(f"WITH {FILES_SQL} SELECT relative_path, sha256(content) AS hash FROM code_files")
def file_hash(spark, sf_dir):
    return sync.file_state(code_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT relative_path, '/' || source AS codebase_path, lang AS language, 0::BIGINT AS chunk_index FROM code_files")
def metadata_json(spark, sf_dir):
    m = F.to_json(F.struct(F.concat(F.lit("/"), "source").alias("codebasePath"), F.col("lang").alias("language"), F.lit(0).alias("chunkIndex")))
    rows = code_files(spark, sf_dir).select("relative_path", m.alias("metadata"))
    return rows.select("relative_path", *[F.get_json_object("metadata", f"$.{k}").alias(n) for k, n in (("codebasePath", "codebase_path"), ("language", "language"))], F.get_json_object("metadata", "$.chunkIndex").cast("long").alias("chunk_index"))


@query(f"""WITH {FILES_SQL}, s AS (SELECT relative_path, content, length(content) % 100 / 100.0 AS score FROM code_files)
SELECT row_number() OVER (ORDER BY score DESC, relative_path) AS rank, relative_path || ':1-' || len(string_split(content, chr(10))) AS location,
  CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS preview,
  CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS match
FROM s QUALIFY rank <= 50""")
def result_format(spark, sf_dir):
    rows = code_files(spark, sf_dir).withColumn("score", F.length("content") % 100 / 100)
    top = rows.orderBy(F.desc("score"), "relative_path").limit(50)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "relative_path")).cast("long")
    return top.select(rank.alias("rank"), text_.location(F.col("relative_path"), F.lit(1), text_.line_count(F.col("content"))).alias("location"), text_.truncated(F.col("content"), 150).alias("preview"), text_.match_bucket(F.col("score")).alias("match"))


# ------------------------------------------------------------------ splitting and sizes


@query(f"""WITH RECURSIVE {FILES_SQL},
line AS (SELECT relative_path, unnest(generate_series(1, len(p))) AS n, unnest(p) AS line FROM (SELECT relative_path, string_split(content, chr(10)) AS p FROM code_files)),
fold AS (
  SELECT relative_path, n, 1 AS chunk, length(line) + 1 AS size FROM line WHERE n = 1
  UNION ALL
  SELECT l.relative_path, l.n, CASE WHEN f.size + length(l.line) + 1 > 1000 THEN f.chunk + 1 ELSE f.chunk END,
         CASE WHEN f.size + length(l.line) + 1 > 1000 THEN length(l.line) + 1 ELSE f.size + length(l.line) + 1 END
  FROM fold f JOIN line l ON l.relative_path = f.relative_path AND l.n = f.n + 1)
SELECT relative_path, chunk - 1 AS pos, string_agg(line, chr(10) ORDER BY n) AS content, min(n) AS start_line, max(n) AS end_line
FROM fold JOIN line USING (relative_path, n) GROUP BY ALL""")
def line_split(spark, sf_dir):
    return split.line_chunks(code_files(spark, sf_dir), 1000).withColumns({c: F.col(c).cast("long") for c in ("pos", "start_line", "end_line")})


@query(f"""WITH {FILES_SQL},
line AS (SELECT relative_path, unnest(generate_series(1, len(p))) AS n, unnest(p) AS line FROM (SELECT relative_path, string_split(content, chr(10)) AS p FROM code_files)),
lagged AS (SELECT *, lag(line) OVER (PARTITION BY relative_path ORDER BY n) AS prev FROM line)
SELECT relative_path, n - 1 AS pos, CASE WHEN prev IS NULL THEN line ELSE right(prev, 300) || chr(10) || line END AS content,
       CASE WHEN prev IS NULL THEN n ELSE greatest(1, n - 1) END AS start_line, n AS end_line FROM lagged""")
def chunk_overlap(spark, sf_dir):
    rows = code_files(spark, sf_dir).select("relative_path", F.posexplode(text_.lines(F.col("content"))).alias("pos", "content"))
    chunks = rows.select("relative_path", "pos", "content", (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 1).alias("end_line"))
    return split.with_overlap(chunks).withColumns({c: F.col(c).cast("long") for c in ("pos", "start_line", "end_line")})


@query("""SELECT doc_id, CASE WHEN text LIKE '%.' || chr(10) || '%' THEN len(string_split(substr(text, 1, instr(text, '.' || chr(10)) - 1), chr(10))) ELSE 1 END::BIGINT AS line FROM documents""")
def estimate_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_.start_line(F.col("text"), F.lit(".\n")).cast("long").alias("line"))


@query("SELECT lang, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY lang")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(text_.token_estimate(F.col("text"))).alias("tokens"))


@query(f"""WITH {FILES_SQL} SELECT relative_path, len(string_split(content, chr(10)))::BIGINT AS n_chunks, length(content)::BIGINT AS n_chars FROM code_files
WHERE len(string_split(content, chr(10))) > 50 OR length(content) > 100000""")
def large_files(spark, sf_dir):
    files = code_files(spark, sf_dir)
    chunks = files.select("relative_path", F.explode(text_.lines(F.col("content"))))
    return split.large_files(chunks, files).select("relative_path", F.col("n_chunks").cast("long").alias("n_chunks"), F.col("n_chars").cast("long").alias("n_chars"))


@query(f"""WITH {FILES_SQL} SELECT relative_path, n - 1 AS pos FROM (SELECT relative_path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS n FROM code_files)
ORDER BY relative_path, pos LIMIT {values.CHUNK_CAP}""")
def chunk_cap(spark, sf_dir):
    lines = code_files(spark, sf_dir).select("relative_path", F.posexplode(text_.lines(F.col("content"))).alias("pos", "content"))
    return split.capped(lines)[0].select("relative_path", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {FILES_SQL} SELECT relative_path, length(trim(content, ' ' || chr(10) || chr(9) || chr(13))) AS n FROM code_files WHERE length(trim(content, ' ' || chr(10) || chr(9) || chr(13))) > 10")
def tiny_chunks(spark, sf_dir):
    n = F.length(text_.trim_all(F.col("content")))
    return code_files(spark, sf_dir).filter(n > values.LINE_LEAST).select("relative_path", n.cast("long").alias("n"))


@query()
def syntax_split(spark, sf_dir):
    files = code_files(spark, sf_dir).withColumn("language", paths.language(F.col("relative_path")))
    return split.Splitter("ast").chunks(files)


# ------------------------------------------------------------------ sync

V2_SQL = f"""{FILES_SQL}, v1 AS (SELECT relative_path, content FROM code_files),
v2 AS (SELECT CASE WHEN source = 'src5' THEN 'moved/' || relative_path ELSE relative_path END AS relative_path,
              CASE WHEN lang = 'de' THEN content || '!' ELSE content END AS content
       FROM code_files WHERE source <> 'src3'),
diff AS (SELECT coalesce(a.relative_path, b.relative_path) AS relative_path,
                CASE WHEN a.relative_path IS NULL THEN 'added' WHEN b.relative_path IS NULL THEN 'removed' ELSE 'modified' END AS change
         FROM v1 a FULL JOIN v2 b USING (relative_path) WHERE sha256(a.content) IS DISTINCT FROM sha256(b.content))"""


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The files, and a later state: one source gone, one moved, one language edited."""
    one = code_files(spark, sf_dir)
    two = one.filter("source <> 'src3'").select(
        F.when(F.col("source") == "src5", F.concat(F.lit("moved/"), "relative_path")).otherwise(F.col("relative_path")).alias("relative_path"),
        F.when(F.col("lang") == "de", F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"),
    )
    return one.select("relative_path", "content"), two


@query(f"WITH {V2_SQL} SELECT relative_path, change FROM diff")
def snapshot_diff(spark, sf_dir):
    one, two = _versions(spark, sf_dir)
    return sync.snapshot_diff(sync.file_state(one), sync.file_state(two))


@query(f"WITH {V2_SQL} SELECT change, count(*) AS n FROM diff GROUP BY change")
def diff_counts(spark, sf_dir):
    return sync.diff_counts(snapshot_diff(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT sha256('root:' || string_agg(sha256(content), '' ORDER BY relative_path)) AS root FROM code_files")
def merkle_root(spark, sf_dir):
    return sync.merkle_root(sync.file_state(code_files(spark, sf_dir)))


@query(f"""WITH {V2_SQL}, n1 AS (SELECT sha256(relative_path || ':' || sha256(content)) AS id FROM v1), n2 AS (SELECT sha256(relative_path || ':' || sha256(content)) AS id FROM v2)
SELECT id, 'removed' AS change FROM n1 WHERE id NOT IN (SELECT id FROM n2) UNION ALL SELECT id, 'added' FROM n2 WHERE id NOT IN (SELECT id FROM n1)""")
def merkle_compare(spark, sf_dir):
    one, two = (sync.merkle_nodes(sync.file_state(v)) for v in _versions(spark, sf_dir))
    return sync.node_changes(one, two)


@query(f"WITH {V2_SQL} SELECT relative_path, sha256(content) AS hash FROM v2")
def reindex_by_change(spark, sf_dir):
    one, two = _versions(spark, sf_dir)
    diff = sync.snapshot_diff(sync.file_state(one), sync.file_state(two))
    return sync.file_state(sync.reindex(one, diff, two))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def delete_by_ids(spark, sf_dir):
    return sync.delete_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


@query("SELECT DISTINCT source AS codebase_path, source IN (SELECT source FROM documents WHERE lang = 'es') AS keep FROM documents")
def reconcile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "codebase_path")
    return sync.reconcile(docs.select("codebase_path").distinct(), docs.filter("lang = 'es'"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    most = docs.count() + labels.select("doc_id").distinct().count()  # never less than what is left, at any size
    return sync.remaining(docs, labels, most, "doc_id")


# ------------------------------------------------------------------ lexical search, listings


@query(f"""WITH {FILES_SQL}, line AS (SELECT relative_path AS file, unnest(generate_series(1, len(p))) AS line_number, unnest(p) AS line_content FROM (SELECT relative_path, string_split(content, chr(10)) AS p FROM code_files WHERE regexp_matches(relative_path, '/[^/]*[.]md$')))
SELECT * FROM line WHERE regexp_matches(line_content, 'Licen[sc]ed? under|[0-9]{{3}}')""")
def grep_lines(spark, sf_dir):
    return evaluate.grep(code_files(spark, sf_dir), "Licen[sc]ed? under|[0-9]{3}", "*.md").withColumn("line_number", F.col("line_number").cast("long"))


@query(f"""WITH {FILES_SQL} SELECT relative_path, array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) AS content, len(string_split(content, chr(10)))::BIGINT AS total_lines, true AS truncated FROM code_files""")
def read_lines(spark, sf_dir):
    return evaluate.read_lines(code_files(spark, sf_dir), 1, 3).withColumn("total_lines", F.col("total_lines").cast("long"))


@query("SELECT DISTINCT source AS name, 'directory' AS kind FROM documents")
def list_dir(spark, sf_dir):
    return evaluate.list_directory(code_files(spark, sf_dir))


@query("SELECT DISTINCT source AS path, 1::BIGINT AS depth FROM documents UNION SELECT DISTINCT source || '/' || lang, 2 FROM documents")
def directory_tree(spark, sf_dir):
    return evaluate.directory_tree(code_files(spark, sf_dir), 2).select("path", F.col("depth").cast("long").alias("depth"))


@query(f"WITH {FILES_SQL} SELECT relative_path FROM code_files WHERE relative_path LIKE '%.py'")
def python_files(spark, sf_dir):
    return evaluate.python_files(code_files(spark, sf_dir), with_tests=False).select("relative_path")


@query("""SELECT url, list_has_any(regexp_split_to_array(lower(url), '[ _/.]'), ['test', 'tests', 'testing']) AS is_test FROM pages""")
def test_file_pred(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", paths.is_test_file(F.col("url")).alias("is_test"))


# ------------------------------------------------------------------ evaluation

HITS_SQL = """h AS (SELECT d.source || '/' || d.doc_id // 20 AS instance_id, d.lang || '/' || d.doc_id AS path, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
m AS (SELECT instance_id, count(*) FILTER (WHERE quality = 1) AS hits, count(*) FILTER (WHERE toxic = 0) AS oracles, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS both_ FROM h GROUP BY instance_id),
pr AS (SELECT instance_id, CASE WHEN hits = 0 THEN 0 ELSE both_ / hits END AS precision, CASE WHEN oracles = 0 THEN 0 ELSE both_ / oracles END AS recall FROM m),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


def _results(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    instance = F.concat("source", F.lit("/"), F.expr("doc_id div 20").cast("string"))  # an instance has few files
    return rows.groupBy(instance.alias("instance_id")).agg(F.collect_list(F.when(F.col("quality") == 1, path)).alias("hits"), F.collect_list(F.when(F.col("toxic") == 0, path)).alias("oracles"))


@query(f"WITH {HITS_SQL} SELECT instance_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def pr_f1(spark, sf_dir):
    scores = evaluate.precision_recall_f1(_results(spark, sf_dir))
    return scores.select("instance_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {HITS_SQL} SELECT 'all' AS method, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, count(DISTINCT instance_id) AS instances FROM f")
def agg_mean_std(spark, sf_dir):
    scores = evaluate.precision_recall_f1(_results(spark, sf_dir)).withColumn("method", F.lit("all"))
    return evaluate.mean_std(scores, ["method"], ["f1"]).select("method", F.round("f1_mean", 6).alias("f1_mean"), F.round("f1_std", 6).alias("f1_std"), "instances")


@query("""SELECT source, round(CASE WHEN count(*) = 0 THEN 0 ELSE (sum(n_chars) - sum(n_chars) FILTER (WHERE lang = 'en')) / sum(n_chars) * 100 END, 6) AS reduction FROM documents GROUP BY source""")
def reduction_pct(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("a"), F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))).alias("b"))
    return sums.select("source", F.round(evaluate.reduction_percent(F.col("a"), F.col("b")), 6).alias("reduction"))


@query("SELECT conv_id, sum(n)::BIGINT AS total, max(n) FILTER (WHERE role = 'user') AS user_calls, max(n) FILTER (WHERE role = 'assistant') AS assistant_calls FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def role_counts(spark, sf_dir):
    counts = evaluate.tool_counts(table(spark, sf_dir, "conversations"), "conv_id", "role")
    return counts.select("conv_id", F.col("total_tool_calls").alias("total"), *[F.try_element_at("tool_call_counts", F.lit(r)).alias(f"{r}_calls") for r in ("user", "assistant")])


@query("""SELECT conv_id, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens, max(i + o) AS max_single_turn_tokens
FROM (SELECT conv_id, CASE WHEN role = 'assistant' THEN 0 ELSE length(coalesce(text, '')) END AS i, CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END AS o FROM conversations) GROUP BY conv_id""")
def token_usage(spark, sf_dir):
    n, said = F.length(F.coalesce("text", F.lit(""))).cast("long"), F.col("role") == "assistant"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.when(said, 0).otherwise(n).alias("input_tokens"), F.when(said, n).otherwise(0).alias("output_tokens"))
    return evaluate.token_usage(turns, "conv_id")


@query("""SELECT conv_id, string_agg('[' || role || '] ' || CASE WHEN len(p) > 30 THEN array_to_string(p[1:30], chr(10)) || chr(10) || '... (' || (len(p) - 30) || ' more lines)' ELSE text END, chr(10) ORDER BY turn) AS summary
FROM (SELECT *, string_split(text, chr(10)) AS p FROM conversations) GROUP BY conv_id""")
def conversation_summary(spark, sf_dir):
    return evaluate.conversation_summary(table(spark, sf_dir, "conversations"))


@query("""WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, ts FROM r WHERE k = 1 ORDER BY ts DESC, user_id LIMIT 5""")
def recent_n(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("indexed_at"))
    return recent(events, 5).select(F.col("id").alias("user_id"), F.col("indexed_at").alias("ts"))


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def age_cutoff(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("now"))
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(newest)).filter(F.col("last") > F.col("now") - F.expr("INTERVAL 1 DAY")).select("user_id", "last")  # newest is one row


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def periodic_counts(spark, sf_dir):
    day = F.window(F.col("ts").cast("timestamp"), "1 day")["start"].cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))


from sablewick.plans import catalogue_stored  # noqa: E402, F401 - registers its queries too
