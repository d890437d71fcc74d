"""What queries over stored collections put on disk, set against the texts that they read."""

import glob
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sablewick.functions.embed import HashEmbedder
from sablewick.operators import search
from sablewick.plans import catalogue_stored
from sablewick.plans.catalogue import QUERIES
from sablewick.sources import store as stored
from sablewick.sources.store import CHUNK_SCHEMA, Store


def shuffled(spark) -> int:
    """Bytes that this application's shuffles have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture
def texts(spark, tmp_path):
    """A folder of input tables, and the bytes of their texts: rows of 200 words out of 20,000."""
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.col("k")), F.lit(20000)).cast("string"))
    words = spark.range(2000).select("id", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("k")).select("id", word.alias("w")).groupBy("id").agg(F.array_join(F.collect_list("w"), " ").alias("text"))
    docs = words.select(F.col("id").alias("doc_id"), F.concat(F.lit("the tion "), "text").alias("text"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("id") % 4 + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 2000, 5).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"), F.lit(0).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]


#: Queries that make a full-text index.
INDEXING = ["bm25_pruned", "store_delete", "bm25_drop_ratio", "weighted_fusion"]


@pytest.mark.parametrize("name", INDEXING)
def test_texts_are_exchanged_and_postings_are_not(spark, texts, name):
    folder, size = texts
    before = shuffled(spark)
    assert QUERIES[name](spark, folder).collect()
    assert shuffled(spark) - before < 1.2 * size


def test_an_index_exchanges_no_texts(spark, texts):
    """Shelves are made where the texts lie; only ids are exchanged."""
    folder, size = texts
    before = shuffled(spark)
    assert QUERIES["store_delete"](spark, folder).count() == 1600
    assert shuffled(spark) - before < 0.1 * size


def chunks(spark, n: int, text):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0).cast("float")).alias("vector"), text.alias("content"), F.concat("id", F.lit(".py")).alias("relative_path"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), F.lit(".py").alias("file_extension"), F.lit("{}").alias("metadata")).select(*[c.split(" ")[0] for c in CHUNK_SCHEMA.split(", ")])


def test_shelves(spark, tmp_path, monkeypatch):
    """Many shelves, over two parts: the postings and the ranking are those of the texts; what is stored is packed."""
    monkeypatch.setattr(stored, "SHELF_CHARS", 1000)
    s = Store(spark, str(tmp_path))
    s.create("c", 1)
    text = F.when(F.col("id") % 50 == 7, "").otherwise(F.concat_ws(" ", F.lit("Fox, été"), F.repeat(F.lit("fox "), (F.col("id") % 5).cast("int")), F.concat(F.lit("w"), F.col("id") % 30), F.concat(F.lit("W"), F.col("id") % 7)))
    s.insert("c", chunks(spark, 600, text))
    s.insert("c", chunks(spark, 300, text).withColumn("id", F.concat(F.lit("b"), "id")))
    assert all(len(glob.glob(f"{tmp_path}/c/terms-{p}/shelf=*")) > 4 for p in s.describe("c")["parts"])
    want = search.postings(s.read("c")).join(search.doc_stats(s.read("c")), "id").select("term", "id", "tf", "dl")
    assert sorted(map(tuple, s.postings("c").collect())) == sorted(map(tuple, want.collect()))
    blocks = s.blocks("c").select("*", F.expr("array_max(rows.tf) AS t"), F.expr("array_min(rows.dl) AS d"))
    assert blocks.filter("n <> size(rows) OR max_tf <> t OR min_dl <> d OR rows <> array_sort(rows)").count() == 0
    top = search.bm25_pruned(s.blocks("c"), s.totals("c"), "fox w7", 5)
    best = search.bm25_stored(s.postings("c"), s.totals("c"), "fox w7").orderBy(F.desc(F.round("score", 9)), "id").limit(5)
    assert [(x["id"], round(x["score"], 9)) for x in top.collect()] == [(x["id"], round(x["score"], 9)) for x in best.collect()]
    files = [f for d, _, names in os.walk(tmp_path) for n in names if (f := f"{d}/{n}").endswith(".parquet")]
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files if pq.ParquetFile(f).metadata.num_rows)


def test_blocks_are_made_a_few_terms_at_a_time():
    """A shelf's blocks are never held at once: what is made of it stands beside its texts, not several times over."""
    rng = np.random.default_rng(3)
    words = [" ".join(f"w{x}" for x in rng.integers(0, 30000, 400)) for _ in range(1000)]
    rows = pa.table({"shelf": pa.array([0] * 1000, pa.int32()), "span": [k % 7 for k in range(1000)], "id": [str(k // 2 * 2 if k > 990 else k) for k in range(1000)], "dl": [400] * 1000, "words": words})
    seen, blocks, base = [], 0, pa.total_allocated_bytes()
    for made in stored._blocks(iter(rows.to_batches(max_chunksize=300))):
        held = list(zip(made["term"].to_pylist(), made["span"].to_pylist()))
        assert made["n"].to_pylist() == [len(x) for x in made["rows"].to_pylist()] and held == sorted(held) and (not seen or seen[-1] < held[0])
        blocks += made.num_rows
        seen.append(held[-1])
        assert made.nbytes < 0.5 * rows.nbytes and pa.total_allocated_bytes() - base < 2 * rows.nbytes
    want = {(w, k % 7) for k, text in enumerate(words) for w in text.split(" ")}
    assert blocks == len(want) and len(seen) > 10


def test_embedding_holds_the_tokens_of_one_text():
    """A batch's tokens become numbers text by text."""
    texts = [" ".join(f"token{(k * x) % 997}" for x in range(2000)) for k in range(200)]
    embedder = HashEmbedder(16)
    one = np.stack([embedder.embed_batch([t])[0] for t in texts])
    tracemalloc.start()
    try:
        found = embedder.embed_batch(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(found, one) and peak < 80 * 200 * 2000


def test_many_deleted_rows_move_no_postings(spark, tmp_path, monkeypatch):
    """More deleted rows than are sent at once: each run of shelves is sent its own, from old parts and new ones."""
    monkeypatch.setattr(stored, "SENT_ROWS", 60)
    s = Store(spark, str(tmp_path))
    s.create("c", 1)
    rows = chunks(spark, 400, F.concat_ws(" ", F.lit("fox"), F.concat(F.lit("w"), F.col("id") % 30)))
    s.insert("c", rows)
    s.change("c", "relative_path", rows.filter("id % 2 = 0").select("relative_path"), rows.filter("id % 4 = 0").withColumn("content", F.lit("fox edited")))
    s.delete("c", rows.filter("id % 4 = 0 OR id % 5 = 1").filter("id < 200").select("id"))
    left = s.postings("c")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") > 3
    want = search.postings(s.read("c")).join(search.doc_stats(s.read("c")), "id").select("term", "id", "tf", "dl")
    assert s.read("c").count() == s.count("c") and sorted(map(tuple, left.collect())) == sorted(map(tuple, want.collect()))


def test_one_file_loses_more_than_is_sent(spark, tmp_path, monkeypatch):
    """The deleted rows of one file go in several shares."""
    monkeypatch.setattr(stored, "SENT_ROWS", 10)
    s = Store(spark, str(tmp_path))
    s.create("c", 1)
    rows = chunks(spark, 90, F.concat_ws(" ", F.lit("fox"), F.concat(F.lit("w"), F.col("id") % 7)))
    s.insert("c", rows.coalesce(1))
    s.delete("c", rows.filter("id % 3 > 0").select("id"))
    left = s.postings("c")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 6
    want = search.postings(s.read("c")).join(search.doc_stats(s.read("c")), "id").select("term", "id", "tf", "dl")
    assert s.count("c") == 30 and sorted(map(tuple, left.collect())) == sorted(map(tuple, want.collect()))


def test_an_id_in_several_files_counts_once(spark, tmp_path, monkeypatch):
    """Rows of one id that come from several partitions share their postings, however the shelves are cut."""
    monkeypatch.setattr(stored, "SHELF_CHARS", 300)
    s = Store(spark, str(tmp_path))
    s.create("c", 1)
    rows = chunks(spark, 120, F.concat_ws(" ", F.lit("fox"), F.concat(F.lit("w"), F.col("id") % 7), F.lit("fox")))
    s.insert("c", rows.unionByName(rows.filter("id % 4 = 0")))
    found = s.postings("c").collect()
    assert s.count("c") == 150 and len({(x["term"], x["id"]) for x in found}) == len(found)
    assert {x["tf"] for x in found if x["term"] == "fox" and int(x["id"]) % 4 == 0} == {4}
    assert {x["tf"] for x in found if x["term"] == "fox" and int(x["id"]) % 4} == {2}
    assert len(s.describe("c")["parts"]) == 1 == len(glob.glob(f"{tmp_path}/c/part-*"))


def test_one_collection_at_a_time(spark, texts, monkeypatch):
    """Each language's collection goes before the next one is filled."""
    seen, insert = [], Store.insert
    monkeypatch.setattr(Store, "insert", lambda self, *a: (seen.append(len(self.list())), insert(self, *a)))
    assert sorted(r["n_rows"] for r in catalogue_stored.store_totals(spark, texts[0]).collect()) == [500] * 4
    assert seen == [1, 1, 1, 1]
