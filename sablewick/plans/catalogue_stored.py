"""Registered queries over collections, saved state, patches, messages and splitters, each with its SQL."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewick.functions import ids, paths, values
from sablewick.functions import text as text_
from sablewick.operators import evaluate, search, split, sync
from sablewick.plans.catalogue import FILES_SQL, QUESTION, TOKENS_SQL, V2_SQL, WHOLE, _bm25_sql, _results, _versions, code_files, collection, query, table
from sablewick.plans.catalogue import HITS_SQL as _HITS_SQL
from sablewick.plans.filters import parse_filter
from sablewick.sources import github
from sablewick.sources.state import REGISTRY, STATE, STATUS, Registry, Versioned, migrated, status_from_json, upsert
from sablewick.sources.store import Files, Store, shared_folder


@contextmanager
def _own_store(spark: SparkSession):
    """An empty store for one query whose rows are known when it ends."""
    store = Store(spark, _scratch(spark, "store"), WHOLE)
    try:
        yield store
    finally:
        store.files.delete(store.root)


def _scratch(spark: SparkSession, kind: str) -> str:
    """A folder for what a query writes; its result is read lazily, so the folder stays until ``clear_scratch``."""
    return f"{shared_folder(spark)}/catalogue-scratch/{kind}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what queries of this application have left: no result may be read after that."""
    Files(spark, shared_folder(spark)).delete(f"{shared_folder(spark)}/catalogue-scratch")


def _store(spark: SparkSession) -> Store:
    return Store(spark, _scratch(spark, "store"), WHOLE)


def _as_chunks(files: DataFrame) -> DataFrame:
    """Rows of ``code_files`` as rows of a collection, with a vector of one number."""
    return files.select(
        F.col("doc_id").cast("string").alias("id"), F.array(F.length("content").cast("float")).alias("vector"), "content", "relative_path", F.lit(1).cast("long").alias("start_line"),
        F.size(F.split("content", "\n", -1)).cast("long").alias("end_line"), paths.extension(F.col("relative_path")).alias("file_extension"), F.to_json(F.struct(F.col("lang").alias("language"))).alias("metadata"),
    )


# ------------------------------------------------------------------ collections


@query(f"WITH {TOKENS_SQL} SELECT doc_id, t AS term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS t FROM toks) GROUP BY doc_id, t")
def full_text_index(spark, sf_dir):
    """The postings that a hybrid collection stores beside its rows."""
    store, name = collection(spark, sf_dir)
    return store.postings(name).select(F.col("id").cast("long").alias("doc_id"), "term", "tf", "dl")


@query(f"""WITH {_bm25_sql().replace('tf AS (', 'every_tf AS (', 1).replace('FROM tf GROUP BY term', 'FROM every_tf GROUP BY term').replace('bm25 AS (', '''
tf AS (SELECT every_tf.* FROM every_tf SEMI JOIN (SELECT term FROM df QUALIFY row_number() OVER (ORDER BY df DESC, term) > floor(0.5 * count(*) OVER ())) USING (term)), bm25 AS (''', 1)}
SELECT doc_id, round(score, 6) AS score FROM bm25""")
def bm25_drop_ratio(spark, sf_dir):
    """The half of the query's terms that weigh least is left out."""
    store, name = collection(spark, sf_dir)
    scores = search.bm25_stored(store.postings(name), store.totals(name), QUESTION, drop_ratio=0.5)
    return scores.select(F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {FILES_SQL} SELECT doc_id::VARCHAR AS id, relative_path, sha256(content) AS hash, length(content)::DOUBLE AS size FROM code_files")
def store_insert(spark, sf_dir):
    """Rows put into a collection in two commits, read back."""
    store, files = _store(spark), code_files(spark, sf_dir)
    store.create("c", 1, hybrid=False)
    for where in ("lang = 'en'", "lang <> 'en' OR lang IS NULL"):
        store.insert("c", _as_chunks(files.filter(where)))
    return store.read("c").select("id", "relative_path", ids.file_hash(F.col("content")).alias("hash"), F.col("vector")[0].cast("double").alias("size"))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def store_delete(spark, sf_dir):
    store = _store(spark)
    store.create("c", 1)
    store.insert("c", _as_chunks(code_files(spark, sf_dir)))
    store.delete("c", table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))
    return store.read("c").select("id")


@query(f"WITH {FILES_SQL} SELECT doc_id::VARCHAR AS id, relative_path FROM code_files WHERE relative_path LIKE '%.py' AND (relative_path LIKE 'src1%' OR len(string_split(content, chr(10))) > 3)")
def store_query(spark, sf_dir):
    store, name = collection(spark, sf_dir)
    return store.query(name, parse_filter("fileExtension == '.py' and (relativePath like 'src1%' or endLine > 3)"), ["id", "relative_path"])


@query(f"WITH {FILES_SQL} SELECT doc_id, relative_path FROM code_files WHERE source = 'src\\1' OR relative_path LIKE '%''%' OR source = 'src2'")
def equality_filter(spark, sf_dir):
    """Quotes and backslashes inside filter strings stand for themselves."""
    where = parse_filter("source == 'src\\\\1' or source == \"src'1\" or source == 'src2'")
    return code_files(spark, sf_dir).filter(where).select("doc_id", "relative_path")


@query("SELECT 'code_chunks_' || source AS name, count(*) AS n FROM documents WHERE source NOT LIKE 'src1%' GROUP BY source UNION ALL SELECT 'other', 0")
def store_collections(spark, sf_dir):
    """Create, fill, drop, list by prefix and count: one collection for each source, and one that stays empty."""
    with _own_store(spark) as store:
        files = code_files(spark, sf_dir)
        for r in files.select("source").distinct().collect():  # one row for each collection
            store.create(f"code_chunks_{r['source']}", 1, hybrid=False)
            store.insert(f"code_chunks_{r['source']}", _as_chunks(files.filter(F.col("source") == r["source"])))
        store.create("other", 1)
        for n in store.list("code_chunks_src1"):
            store.drop(n)
        return spark.createDataFrame([(n, store.count(n)) for n in [*store.list("code_chunks_"), "other"]], "name string, n long")


@query("SELECT lang, count(*) AS n_rows, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')))::BIGINT AS n_terms FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def store_totals(spark, sf_dir):
    """Rows and terms of each collection, as its pointer tells them."""
    found = []
    with _own_store(spark) as store:
        files = code_files(spark, sf_dir)
        for r in files.filter("lang IS NOT NULL").select("lang").distinct().collect():  # one collection for each language
            store.create(r["lang"], 1)
            store.insert(r["lang"], _as_chunks(files.filter(F.col("lang") == r["lang"])))
            found.append((r["lang"], *store.totals(r["lang"])))
            store.drop(r["lang"])
    return spark.createDataFrame(found, "lang string, n_rows long, n_terms long")


@query(f"""WITH {FILES_SQL} SELECT relative_path, sha256(content) AS hash FROM code_files WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT relative_path, sha256(content || '!') FROM code_files WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def store_replace(spark, sf_dir):
    """A collection after a sync: some files gone, some new, some left out by their ids; the replaced version is read while the new one is written."""
    store, files = _store(spark), code_files(spark, sf_dir)
    store.create("c", 1, hybrid=False)
    store.insert("c", _as_chunks(files.filter("lang IN ('en', 'fr')")))
    diff = files.filter("lang IN ('fr', 'de')").select("relative_path", F.when(F.col("lang") == "fr", "removed").otherwise("added").alias("change"))
    fresh = _as_chunks(files.filter("lang = 'de'").withColumn("content", F.concat("content", F.lit("!"))))
    store.replace("c", sync.reindex(store.read("c"), diff, fresh))
    store.delete("c", table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("id")))
    return sync.file_state(store.read("c"))


@query(f"""WITH {TOKENS_SQL}, {FILES_SQL}, kept AS (SELECT doc_id FROM documents WHERE lang <> 'de' OR lang IS NULL),
own AS (SELECT doc_id, t FROM toks WHERE doc_id IN (SELECT doc_id FROM kept)),
fresh AS (SELECT doc_id, regexp_extract_all(lower(content || ' edited'), '[a-z0-9_]+') AS t FROM code_files WHERE lang = 'de' AND source <> 'src1'),
every AS (SELECT * FROM own UNION ALL SELECT * FROM fresh)
SELECT doc_id, t AS term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS t FROM every) GROUP BY doc_id, t""")
def store_change(spark, sf_dir):
    """The full-text index after one commit that replaced the files of a language, but for those of one source, by edited ones."""
    store, files = _store(spark), code_files(spark, sf_dir)
    store.create("c", 1)
    store.insert("c", _as_chunks(files))
    stale = files.filter("lang = 'de'")
    edited = stale.filter("source <> 'src1'").withColumn("content", F.concat("content", F.lit(" edited")))
    store.change("c", "relative_path", stale.select("relative_path"), _as_chunks(edited))
    return store.postings("c").select(F.col("id").cast("long").alias("doc_id"), "term", "tf", "dl")


# ------------------------------------------------------------------ saved state


@query(f"""WITH {FILES_SQL}, root AS (SELECT sha256('root:' || string_agg(sha256(content), '' ORDER BY relative_path)) AS id FROM code_files)
SELECT sha256(relative_path || ':' || sha256(content)) AS id, relative_path, (SELECT id FROM root) AS parent FROM code_files UNION ALL SELECT id, NULL, NULL FROM root""")
def merkle_tree(spark, sf_dir):
    """All nodes of the tree over the files, through its accessors."""
    tree = sync.merkle_tree(sync.file_state(code_files(spark, sf_dir)))
    return sync.leaf_nodes(tree).unionByName(sync.root_nodes(tree)).select("id", "relative_path", "parent")


_NODES_SQL = """{name} AS (
  SELECT path, len(p) AS depth, CASE WHEN len(p) > 0 THEN array_to_string(p[:-2], '/') END AS parent, count(*) AS n_files, {words}
  FROM (SELECT sha256(relative_path || ':' || sha256(content)) AS leaf, string_split(relative_path, '/') AS s, unnest(generate_series(0, len(s) - 1)) AS d, s[:d] AS p, array_to_string(p, '/') AS path FROM {of})
  GROUP BY path, p)""".replace("{words}", ", ".join(f"bit_xor(('0x' || substr(leaf, {1 + 15 * k}, 15))::BIGINT) AS w{k}" for k in range(4)))
_DIGEST_SQL = "sha256(concat_ws(':', w0, w1, w2, w3, n_files))"


@query(f"WITH {FILES_SQL}, {_NODES_SQL.format(name='node', of='code_files')} SELECT path, depth, parent, {_DIGEST_SQL} AS digest, n_files FROM node")
def merkle_directories(spark, sf_dir):
    """A digest for every directory, over all files below it."""
    return sync.directory_nodes(sync.file_state(code_files(spark, sf_dir))).withColumn("depth", F.col("depth").cast("long"))


@query(f"""WITH {V2_SQL}, {_NODES_SQL.format(name='a', of='v1')}, {_NODES_SQL.format(name='b', of='v2')}
SELECT coalesce(a.path, b.path) AS path FROM (SELECT path, {_DIGEST_SQL} AS x FROM a) a FULL JOIN (SELECT path, {_DIGEST_SQL} AS x FROM b) b USING (path) WHERE a.x IS DISTINCT FROM b.x""")
def merkle_changed(spark, sf_dir):
    """The directories that differ between two versions, found from the root downwards."""
    return sync.changed_directories(*[sync.directory_nodes(sync.file_state(v)) for v in _versions(spark, sf_dir)])


@query(f"WITH {V2_SQL} SELECT * FROM diff")
def tree_diff(spark, sf_dir):
    """The files that differ, looked for in directories that differ only."""
    old, new = (sync.file_state(v) for v in _versions(spark, sf_dir))
    return sync.tree_diff(old, new, sync.directory_nodes(old), sync.directory_nodes(new))


@query("SELECT source AS codebase_path, 'indexed' AS status, count(*) AS indexed_files FROM documents WHERE source NOT LIKE 'src1%' GROUP BY source")
def status_migrated(spark, sf_dir):
    """A status file taken into the saved table without trees that are gone; read back from there."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).collect()  # one row for each codebase
    folder = _scratch(spark, "status")
    books = {r["source"]: {"status": "indexed", "indexedFiles": r["n"]} for r in rows}
    Files(spark, folder).write(f"{folder}/v2.json", json.dumps({"formatVersion": "v2", "codebases": books}))
    statuses = Versioned(spark, f"{folder}/saved", STATUS)
    migrated(spark, statuses, f"{folder}/v2.json", lambda path: not path.startswith("src1"))
    return statuses.load("status").select("codebase_path", "status", "indexed_files")


@query(f"WITH {FILES_SQL} SELECT relative_path, sha256(content) AS hash FROM code_files")
def state_snapshot(spark, sf_dir):
    """File hashes saved twice under one key and loaded."""
    states = Versioned(spark, _scratch(spark, "states"), STATE)
    states.save("k", sync.file_state(code_files(spark, sf_dir)).filter("relative_path < 'm'"))
    states.save("k", sync.file_state(code_files(spark, sf_dir)))
    return states.load("k")


@query("""SELECT source AS codebase_path, CASE WHEN bool_or(lang = 'es') THEN 'indexed' ELSE 'indexing' END AS status, count(*) AS indexed_files FROM documents GROUP BY source""")
def status_upsert(spark, sf_dir):
    """A status table in which some entries are replaced by newer ones."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.groupBy(F.col("source").alias("codebase_path")).agg(F.lit("indexing").alias("status"), F.count("*").alias("indexed_files"), F.max(F.col("lang") == "es").alias("done"))
    old = rows.select("codebase_path", "status", (F.col("indexed_files")).alias("indexed_files"))
    newer = rows.filter("done").select("codebase_path", F.lit("indexed").alias("status"), "indexed_files")
    return upsert(old, newer, "codebase_path")


@query("SELECT source AS codebase_path, 'indexed' AS status, count(*) AS indexed_files, sum(length(text))::BIGINT AS total_chunks FROM documents WHERE lang = 'en' GROUP BY source UNION ALL SELECT 'v1/' || source, 'indexed', NULL, NULL FROM documents WHERE lang = 'en' GROUP BY source")
def status_migrate(spark, sf_dir):
    """Status files of both versions read as one table; interrupted entries count as not indexed."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.filter("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()  # one row for each codebase
    folder = _scratch(spark, "status")
    books = {r["source"]: {"status": "indexed", "indexedFiles": r["n"], "totalChunks": r["c"], "indexStatus": "completed"} for r in rows}
    books["half"] = {"status": "indexing", "indexingPercentage": 40}
    files = Files(spark, folder)
    files.write(f"{folder}/v2.json", json.dumps({"formatVersion": "v2", "codebases": books}))
    files.write(f"{folder}/v1.json", json.dumps({"indexedCodebases": [f"v1/{r['source']}" for r in rows], "indexingCodebases": ["v1/half"]}))
    found = [status_from_json(spark, f"{folder}/{n}.json") for n in ("v1", "v2")]
    return found[0].unionByName(found[1]).select("codebase_path", "status", "indexed_files", "total_chunks")


@query("""WITH r AS (SELECT source AS id, max(doc_id) AS seen FROM documents GROUP BY source ORDER BY seen DESC, id LIMIT 5)
SELECT id, seen FROM r WHERE seen > (SELECT max(doc_id) FROM documents) - 30 * 86400""")
def registry_entries(spark, sf_dir):
    """The registry keeps the newest entry of each repository, the five newest of all, and none older than a month."""
    last = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.max("doc_id").alias("at"))
    newest = last.agg(F.max("at")).first()[0]
    rows = last.select("id", F.timestamp_seconds("at").alias("indexed_at"), F.concat(F.lit("c_"), "id").alias("collection_name"))
    book = Registry(spark, _scratch(spark, "registry"))
    wide = spark.createDataFrame([], REGISTRY).unionByName(rows, allowMissingColumns=True)
    book.add(wide.withColumn("indexed_at", F.timestamp_seconds(F.lit(0))))
    book.add(wide)
    book.clean(spark.sql(f"SELECT timestamp_seconds({newest}) AS t").first()["t"])
    return book.rows().select("id", F.unix_seconds("indexed_at").alias("seen"))


@query(f"WITH {_HITS_SQL} SELECT instance_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def result_files(spark, sf_dir):
    """Evaluation results written as JSON lines, read back and scored."""
    path = _scratch(spark, "results")
    _results(spark, sf_dir).write.json(path)
    scores = evaluate.precision_recall_f1(evaluate.read_results(spark, path, lines=True).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("hits", "oracles")}))
    return scores.select("instance_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# ------------------------------------------------------------------ syntax

JS_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8232) || chr(8233)"

#: Each line of a text as a definition that has it as a comment: (language, where, head, line's prefix, rest); ``#`` stands for the line's number.
GENERATED = {
    "python": ("lang = 'fr'", "def f#(a):", "    # ", "    return \"}\""),
    "typescript": ("lang = 'de'", "export function f#(\n  a: string) {", "  // ", "  return `}${a}`;\n}"),
    "java": ("lang IS DISTINCT FROM 'fr' AND lang IS DISTINCT FROM 'de'", "  int f#(String a)\n  {", "    // ", "    return '}';\n  }"),
}


def _generated_sql() -> str:
    rows = []
    for name, (where, head, prefix, rest) in GENERATED.items():
        made = "chr(10) || ".join("'" + part.replace("'", "''") + "' || " for part in head.split("\n")).replace("#", "' || n || '")
        tail = " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in rest.split("\n"))
        rows.append(f"SELECT relative_path, n, '{name}' AS language, {made}chr(10) || '{prefix}' || line || chr(10) || {tail} AS node, {head.count(chr(10)) + rest.count(chr(10)) + 3} AS high FROM line WHERE {where}")
    return f"""WITH {FILES_SQL},
line AS (SELECT relative_path, lang, unnest(generate_series(1, len(p))) AS n, unnest(p) AS line FROM (SELECT relative_path, lang, string_split(content, chr(10)) AS p FROM code_files)),
node AS ({" UNION ALL ".join(rows)}),
java AS (SELECT relative_path, 'class C {{' || chr(10) || string_agg(node, chr(10) ORDER BY n) || chr(10) || '}}' AS node, max(n) * any_value(high) + 2 AS high FROM node WHERE language = 'java' GROUP BY relative_path)
SELECT relative_path, CASE language WHEN 'typescript' THEN 2 * n - 2 WHEN 'java' THEN n ELSE n - 1 END::BIGINT AS pos, sha256(trim(node, ' ')) AS hash,
       ((n - 1) * high + 1 + CASE language WHEN 'java' THEN 1 ELSE 0 END)::BIGINT AS start_line, (n * high + CASE language WHEN 'java' THEN 1 ELSE 0 END)::BIGINT AS end_line FROM node
UNION ALL SELECT relative_path, (2 * n - 1)::BIGINT, sha256(substr(node, 8)), ((n - 1) * high + 1)::BIGINT, (n * high)::BIGINT FROM node WHERE language = 'typescript'
UNION ALL SELECT relative_path, 0, sha256(node), 1, high::BIGINT FROM java"""


def _separators_sql() -> str:
    listed = []
    for language, extension in (("python", ".py"), ("typescript", ".ts"), ("java", ".java"), ("text", ".md")):
        seps = ", ".join("'" + x.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for x in split.separators(language))
        listed.append(f"('{extension}', '{language}', [{seps}])")
    return ", ".join(listed)


_SIZE, _STEP = values.CHAR_CHUNK, values.CHAR_CHUNK - values.CHAR_OVERLAP
#: A character that no text holds marks where a text is cut; before two line breaks also within a longer row of them.
_CUT = "chr(57344)"
_MARKED = f"""CASE WHEN sep = chr(10) || chr(10) THEN regexp_replace(replace(s, chr(10), {_CUT} || chr(10)), {_CUT} || chr(10) || '([^' || {_CUT} || ']|$)', chr(10) || '\\1', 'g') ELSE replace(s, sep, {_CUT} || sep) END"""


@query(f"""WITH RECURSIVE {FILES_SQL}, seps(extension, language, seps) AS (VALUES {_separators_sql()}),
whole AS (SELECT relative_path, content, language, seps FROM code_files JOIN seps ON regexp_extract(relative_path, '[.][a-z]+$') = extension),
piece AS (
  SELECT relative_path, seps, content AS s, 1 AS level, []::BIGINT[] AS ord, []::BIGINT[] AS parent, true AS long FROM whole
  UNION ALL
  SELECT relative_path, seps, p.s, level, list_append(ord, p.n), ord, length(p.s) >= {_SIZE}
  FROM (
    SELECT relative_path, seps, ord, own + 1 AS level, unnest(list_transform(list_filter(string_split({_MARKED}, {_CUT}), lambda x: x <> ''), lambda x, i: {{'s': x, 'n': i}})) AS p
    FROM (SELECT *, seps[own] AS sep FROM (SELECT *, list_min(list_filter(range(level, len(seps) + 1), lambda k: seps[k] = '' OR contains(s, seps[k]))) AS own FROM piece WHERE long))
    WHERE sep <> '')),
leaf AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY relative_path ORDER BY ord)::BIGINT - length(s) AS begins
  FROM piece WHERE NOT long OR (length(s) > 0 AND len(list_filter(range(level, len(seps) + 1), lambda k: seps[k] <> '' AND contains(s, seps[k]))) = 0)),
placed AS (SELECT relative_path, s, long, begins, parent, ord, (SELECT count(*) FROM piece b WHERE b.relative_path = leaf.relative_path AND b.parent = leaf.parent AND b.long AND len(b.ord) > 0 AND b.ord < leaf.ord) AS before FROM leaf),
run AS (
  SELECT relative_path, parent, before, string_agg(s, '' ORDER BY ord) AS t, min(begins) AS begins, list_prepend(0, list(upto ORDER BY ord)) AS q
  FROM (SELECT *, sum(length(s)) OVER (PARTITION BY relative_path, parent, before ORDER BY ord)::BIGINT AS upto FROM placed WHERE NOT long) GROUP BY ALL),
fold AS (
  SELECT relative_path, t, begins, q, 1::BIGINT AS a, len(list_filter(q[2:{_SIZE} + 2], lambda x: x <= {_SIZE}))::BIGINT AS b FROM run
  UNION ALL
  SELECT relative_path, t, begins, q, a, a - 1 + len(list_filter(q[a + 1:a + {_SIZE} + 1], lambda x: x - q[a] <= {_SIZE})) AS b
  FROM (SELECT relative_path, t, begins, q, a + len(list_filter(q[a:b], lambda x: x < greatest(q[b + 1] - {values.CHAR_OVERLAP}, q[b + 2] - {_SIZE}))) AS a FROM fold WHERE b + 1 < len(q))),
chunk AS (
  SELECT relative_path, begins + q[a] AS begins, substr(t, q[a] + 1, q[b + 1] - q[a]) AS c FROM fold
  UNION ALL
  SELECT relative_path, begins + k * {_STEP}, substr(s, k * {_STEP} + 1, {_SIZE})
  FROM (SELECT *, unnest(range(0, 1 + greatest(0, ceil((length(s) - {_SIZE}) / {_STEP}))::BIGINT)) AS k FROM leaf WHERE long)),
lined AS (
  SELECT relative_path, begins, trim(c, {JS_BLANK}) AS content, begins + length(c) - length(ltrim(c, {JS_BLANK})) AS first FROM chunk WHERE trim(c, {JS_BLANK}) <> ''),
numbered AS (
  SELECT l.relative_path, l.begins, l.content, language, len(string_split(substr(w.content, 1, first), chr(10))) AS start_line, len(string_split(l.content, chr(10))) - 1 AS more
  FROM lined l JOIN whole w USING (relative_path)),
once AS (SELECT relative_path, min(begins) AS begins, content, language, start_line, start_line + more AS end_line FROM numbered GROUP BY ALL)
SELECT relative_path, row_number() OVER (PARTITION BY relative_path ORDER BY begins) - 1 AS pos, content, start_line, end_line, language FROM once""")
def recursive_split(spark, sf_dir):
    """All files by characters: separators of their language from coarse to fine, neighbours joined level by level, with overlap and lines."""
    files = code_files(spark, sf_dir).withColumn("language", paths.language(F.col("relative_path")))
    return split.Splitter("langchain").chunks(files).withColumn("pos", F.col("pos").cast("long"))


def _definition(head: str, prefix: str, rest: str):
    return lambda line, i: F.concat(F.replace(F.lit(head + "\n"), F.lit("#"), (i + 1).cast("string")), F.lit(prefix), line, F.lit("\n" + rest))


@query(_generated_sql())
def syntax_nodes(spark, sf_dir):
    """Generated source files whose comments hold every line of every text: each definition is a chunk, with its place."""
    language = F.when(F.col("lang") == "fr", "python").when(F.col("lang") == "de", "typescript").otherwise("java")
    files = code_files(spark, sf_dir).withColumn("language", language)
    made = F.lit(None).cast("string")
    for name, (_, head, prefix, rest) in GENERATED.items():
        body = F.array_join(F.transform(text_.lines(F.col("content")), _definition(head, prefix, rest)), "\n")
        made = F.when(F.col("language") == name, F.concat(F.lit("class C {\n"), body, F.lit("\n}")) if name == "java" else body).otherwise(made)
    chunks = split.Splitter("ast", size=1 << 30, overlap=0).chunks(files.withColumn("content", made))
    return chunks.select("relative_path", F.col("pos").cast("long").alias("pos"), ids.file_hash(F.col("content")).alias("hash"), "start_line", "end_line")


# ------------------------------------------------------------------ hosted repositories, patches, messages


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def github_decode(spark, sf_dir):
    """Contents as a hosting service sends them: Base64 in lines."""
    sent = F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "(.{60})", "$1\n")
    return table(spark, sf_dir, "documents").select("doc_id", ids.file_hash(github.decoded(sent)).alias("hash"))


@query(f"WITH {FILES_SQL} SELECT relative_path AS path FROM code_files WHERE source <> 'src2'")
def github_tree(spark, sf_dir):
    """Blobs of known extensions out of a repository's tree."""
    tree = code_files(spark, sf_dir).select(F.col("relative_path").alias("path"), F.when(F.col("source") == "src2", "tree").otherwise("blob").alias("type"))
    tree = tree.unionByName(tree.select(F.concat("path", F.lit(".lock")).alias("path"), "type"))
    return github.source_files(tree).select("path")


#: Patches that change, for each document, as many files as its id says, and create one.
def _patches(spark, sf_dir) -> DataFrame:
    one = lambda k: F.concat(F.lit("diff --git a/p"), k, F.lit(".py b/p"), k, F.lit(".py\n--- a/p"), k, F.lit(".py\n+++ b/p"), k, F.lit(".py\n@@ -1 +1 @@\n-x\n+y\n"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("doc_id") % 3), lambda k: one(k.cast("string"))), "")
    new = F.lit("diff --git a/new.py b/new.py\n--- /dev/null\n+++ b/new.py\n")
    level = F.when(F.col("lang") == "en", "15 min - 1 hour").otherwise("1-4 hours")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(changed, new).alias("patch"), level.alias("difficulty"))


@query("""SELECT doc_id, array_to_string(list_transform(generate_series(0, doc_id % 3), lambda k: 'p' || k || '.py'), ' ') AS oracles,
array_to_string(list_transform(generate_series(0, doc_id % 3), lambda k: 'p' || k || '.py'), ' ') || ' new.py' AS files FROM documents""")
def patch_files(spark, sf_dir):
    rows = _patches(spark, sf_dir)
    return rows.select("doc_id", F.array_join(evaluate.oracle_files(F.col("patch")), " ").alias("oracles"), F.array_join(evaluate.patch_files(F.col("patch")), " ").alias("files"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 3 = 0")
def instance_subset(spark, sf_dir):
    return evaluate.instance_subset(_patches(spark, sf_dir)).select("doc_id")


@query("SELECT count(*) FILTER (WHERE lang = 'en' AND doc_id % 3 = 0) AS n, round(100 * count(*) FILTER (WHERE lang = 'en' AND doc_id % 3 = 0) / count(*), 1) AS percent FROM documents")
def subset_statistics(spark, sf_dir):
    rows = _patches(spark, sf_dir)
    return evaluate.subset_statistics(evaluate.instance_subset(rows), rows)


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first, role) - 1 AS pos, role || '.py' AS path FROM f""")
def edited_files(spark, sf_dir):
    """Files named by edit results and edit calls in messages, each once, in order."""
    call = F.concat(F.lit("edit {'file_path': '/repo/"), "role", F.lit(".py'}"))
    said = F.concat(F.lit("Successfully modified file: /repo/"), "role", F.lit(".py\n"), call)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("instance_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, said).otherwise(call).alias("content"))
    return evaluate.edited_files(turns, "/repo").select(F.col("instance_id").alias("conv_id"), F.col("pos").cast("long").alias("pos"), "path")


@query("SELECT conv_id, turn, role || '.py' AS file_path, sha256(coalesce(text, '')) AS old_hash, sha256(coalesce(text, '') || '!') AS new_hash FROM conversations WHERE role = 'assistant'")
def edit_calls(spark, sf_dir):
    """Arguments of edit calls, out of JSON."""
    text = F.coalesce("text", F.lit(""))
    args = F.to_json(F.struct(F.concat("role", F.lit(".py")).alias("file_path"), text.alias("old_string"), F.concat(text, F.lit("!")).alias("new_string")))
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("instance_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "edit").otherwise("search").alias("tool"), args.alias("arguments"))
    return evaluate.edit_calls(calls).select(F.col("instance_id").alias("conv_id"), F.col("seq").alias("turn"), "file_path", ids.file_hash(F.col("old_string")).alias("old_hash"), ids.file_hash(F.col("new_string")).alias("new_hash"))


@query(f"""WITH {FILES_SQL} SELECT relative_path AS file, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[0-9]{{3}}'))) AS n FROM code_files
WHERE len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[0-9]{{3}}'))) > 0""")
def match_counts(spark, sf_dir):
    return evaluate.match_counts(code_files(spark, sf_dir), "[0-9]{3}")


# ------------------------------------------------------------------ paths


@query(f"""WITH {FILES_SQL}, p AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '.hidden/' || relative_path WHEN doc_id % 5 = 1 THEN 'node_modules/' || relative_path ELSE relative_path END AS relative_path FROM code_files)
SELECT relative_path FROM p WHERE relative_path NOT LIKE '.hidden/%' AND relative_path NOT LIKE 'node_modules/%'""")
def sync_paths(spark, sf_dir):
    """The path predicate with the rule on hidden files."""
    moved = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(".hidden/"), "relative_path")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("node_modules/"), "relative_path")).otherwise(F.col("relative_path"))
    return code_files(spark, sf_dir).select(moved.alias("relative_path")).filter(paths.indexable(F.col("relative_path"), skip_hidden=True))


# ------------------------------------------------------------------ splitters

LARGE, TAIL = values.SYNTAX_CHUNK, values.SYNTAX_OVERLAP


@query(f"""WITH RECURSIVE {FILES_SQL},
line AS (SELECT relative_path, length(content) > {LARGE} AS large, len(p) AS many, unnest(generate_series(1, len(p))) AS n, unnest(p) AS line FROM (SELECT relative_path, content, string_split(content, chr(10)) AS p FROM code_files)),
sized AS (SELECT *, length(line) + CASE WHEN n < many THEN 1 ELSE 0 END AS k FROM line),
fold AS (
  SELECT relative_path, n, 1 AS chunk, k AS size FROM sized WHERE n = 1
  UNION ALL
  SELECT l.relative_path, l.n, CASE WHEN l.large AND f.size > 0 AND f.size + l.k > {LARGE} THEN f.chunk + 1 ELSE f.chunk END,
         CASE WHEN l.large AND f.size > 0 AND f.size + l.k > {LARGE} THEN l.k ELSE f.size + l.k END
  FROM fold f JOIN sized l ON l.relative_path = f.relative_path AND l.n = f.n + 1),
piece AS (
  SELECT relative_path, chunk, min(n) AS first, max(n) AS last, CASE WHEN any_value(large) THEN trim(string_agg(line, chr(10) ORDER BY n), {JS_BLANK}) ELSE string_agg(line, chr(10) ORDER BY n) END AS content
  FROM fold JOIN sized USING (relative_path, n) GROUP BY ALL),
kept AS (SELECT *, row_number() OVER w - 1 AS pos, lag(content) OVER w AS before FROM piece WHERE trim(content, {JS_BLANK}) <> '' OR (first = 1 AND chunk = 1 AND relative_path IN (SELECT relative_path FROM code_files WHERE length(content) <= {LARGE})) WINDOW w AS (PARTITION BY relative_path ORDER BY chunk))
SELECT relative_path, pos, CASE WHEN before IS NULL THEN content ELSE right(before, {TAIL}) || chr(10) || content END AS content,
       CASE WHEN before IS NULL THEN first ELSE greatest(1, first - len(string_split(right(before, {TAIL}), chr(10)))) END AS start_line, last AS end_line FROM kept""")
def syntax_split_lines(spark, sf_dir):
    """All files as TypeScript: none holds a definition, so whole files stay or are packed by lines, with overlap."""
    files = code_files(spark, sf_dir).withColumn("language", F.lit("typescript"))
    return split.Splitter("ast").chunks(files).select("relative_path", F.col("pos").cast("long").alias("pos"), "content", "start_line", "end_line")


@query(f"""WITH {FILES_SQL}, solid AS (SELECT relative_path, regexp_replace(content, '\\s', '', 'g') AS c FROM code_files)
SELECT relative_path, row_number() OVER (PARTITION BY relative_path ORDER BY min(k)) - 1 AS pos, piece AS content, 1::BIGINT AS start_line, 1::BIGINT AS end_line
FROM (SELECT relative_path, k, substr(c, k * {values.CHAR_CHUNK - values.CHAR_OVERLAP} + 1, {values.CHAR_CHUNK}) AS piece
      FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil((length(c) - {values.CHAR_CHUNK}) / {values.CHAR_CHUNK - values.CHAR_OVERLAP}))::BIGINT)) AS k FROM solid) WHERE c <> '')
GROUP BY relative_path, piece""")
def recursive_split_unbroken(spark, sf_dir):
    """Texts without any separator are cut into overlapping windows of the chunk size; a chunk that is there twice (same lines, same text) comes once."""
    files = code_files(spark, sf_dir).select("relative_path", F.regexp_replace("content", "[\\t\\n\\f\\r ]", "").alias("content"), F.lit("text").alias("language"))
    return split.Splitter("langchain").chunks(files).select("relative_path", F.col("pos").cast("long").alias("pos"), "content", "start_line", "end_line")
