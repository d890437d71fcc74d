"""The merge-on-read store, pruned search, the retry ledger, directory digests and the change log."""

import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablewick.functions.embed import Embedder
from sablewick.operators import search, sync
from sablewick.plans.engine import Config, Engine
from sablewick.sources.state import STATUS, Versioned, migrated
from sablewick.sources.store import CHUNK_SCHEMA, LimitReached, Store
from sablewick.streaming.changes import ChangeLog


def chunks(spark, texts: dict[str, str]):
    rows = [(i, [1.0], t, f"{i.split(':')[0]}.py", 1, 2, ".py", "{}") for i, t in texts.items()]
    return spark.createDataFrame(rows, CHUNK_SCHEMA)


def ids_of(df):
    return sorted(r["id"] for r in df.select("id").collect())


def written_rows(spark, folder, kind):
    return {n: spark.read.parquet(f"{folder}/{n}").count() for n in os.listdir(folder) if n.startswith(kind)}


def test_change_writes_what_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path), retention=0)
    s.create("c", 1)
    s.insert("c", chunks(spark, {f"f{k}:{n}": f"word{k} common text {n}" for k in range(50) for n in range(4)}))
    whole = set(s.describe("c")["parts"])
    s.change("c", "relative_path", ["f7.py"], chunks(spark, {"f7:0": "edited common", "f7:9": "new"}))
    about = s.describe("c")
    assert whole < set(about["parts"]) and len(about["parts"]) == 2  # the old part stays as it is
    assert sorted(written_rows(spark, tmp_path / "c", "part-").values()) == [2, 200]
    assert list(written_rows(spark, tmp_path / "c", "gone-").values()) == [4]
    assert s.totals("c") == (198, 196 * 4 + 3) and s.count("c") == s.read("c").count()
    assert ids_of(s.read("c").filter("relative_path = 'f7.py'")) == ["f7:0", "f7:9"]  # an id may come back
    assert s.fetch("c", ["f7:0", "f7:1", "f8:1"]).count() == 2
    assert s.postings("c").filter("term = 'word7'").count() == 0 and s.postings("c").filter("term = 'common'").count() == 197
    s.change("c", "id", ["nothing"])
    assert s.describe("c")["parts"] == about["parts"] and s.describe("c")["gone"] == about["gone"]


def test_old_folders_expire(spark, tmp_path):
    s = Store(spark, str(tmp_path), retention=3600)
    s.create("c", 1)
    s.insert("c", chunks(spark, {"a:0": "x"}))
    first = set(s.describe("c")["parts"])
    s.replace("c", chunks(spark, {"b:0": "y"}))
    assert first <= set(os.listdir(tmp_path / "c"))  # readers may be at it
    later = Store(spark, str(tmp_path), retention=0)
    later.insert("c", chunks(spark, {"c:0": "z"}))
    left = {n for n in os.listdir(tmp_path / "c") if n.startswith(("part-", "terms-"))}
    assert left == {f"{k}{p}" for p in later.describe("c")["parts"] for k in ("", "terms-")} and not later.describe("c")["retired"]


def test_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path), retention=0)
    s.create("c", 1)
    s.insert("c", chunks(spark, {f"a:{n}": "one two" for n in range(10)}))
    s.insert("c", chunks(spark, {f"b:{n}": "three" for n in range(10)}))
    kept = [p for p, (n, t) in s.describe("c")["parts"].items() if t == 10]
    s.delete("c", [f"a:{n}" for n in range(6)] + ["b:0"])
    before = s.totals("c"), ids_of(s.read("c")), sorted(map(tuple, s.postings("c").collect()))
    assert len(s.compact("c")) == 1 and kept[0] in s.describe("c")["parts"]
    assert (s.totals("c"), ids_of(s.read("c")), sorted(map(tuple, s.postings("c").collect()))) == before
    assert s.describe("c")["parts"].keys() - set(kept) and s.compact("c") == []
    s.delete("c", s.read("c").select("id"))
    s.compact("c")
    assert s.describe("c")["parts"] == {} == s.describe("c")["gone"] and s.totals("c") == (0, 0) and s.read("c").count() == 0


def test_fetch_is_pushed_down(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.create("c", 1)
    s.insert("c", chunks(spark, {f"a:{n}": "text" for n in range(100)}))
    top = spark.createDataFrame([(f"a:{n}", 1.0 / (n + 1)) for n in range(15)], "id string, score double")
    shown = search.as_results(top, s.read("c").withColumn("language", F.lit("x")))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*Or\(In\(id", plan), plan
    assert shown.count() == 15 and shown.first()["score"] == 1.0


def test_pruned_search_reads_few_blocks(spark, tmp_path):
    """Short rows with many repeats of a rare word score best; long ones can't reach them and aren't read."""
    s = Store(spark, str(tmp_path))
    s.create("c", 1)
    r = np.random.default_rng(3)
    texts = {f"a:{n}": " ".join(["fox"] * int(r.integers(1, 3)) + [f"w{x}" for x in r.integers(0, 500, int(r.integers(5, 400)))]) for n in range(3000)}
    s.insert("c", chunks(spark, texts))
    told = search.Pruned()
    best = search.bm25_pruned(s.blocks("c"), s.totals("c"), "fox w7", 5, told=told)
    want = search.bm25_stored(s.postings("c"), s.totals("c"), "fox w7").orderBy(F.desc(F.round("score", 9)), "id").limit(5)
    assert [(x["id"], round(x["score"], 9)) for x in best.collect()] == [(x["id"], round(x["score"], 9)) for x in want.collect()]
    assert told.spans > 30 and told.read < told.spans / 2
    # the same after the best rows are deleted, and among some rows only
    s.delete("c", [x["id"] for x in best.collect()][:3])
    only = s.read("c").filter("id LIKE '%1'")
    got = search.bm25_pruned(s.blocks("c"), s.totals("c"), "fox w7", 5, gone=s.gone("c"), only=only)
    want = search.bm25_stored(s.postings("c"), s.totals("c"), "fox w7", docs=s.read("c"), where=F.col("id").like("%1")).orderBy(F.desc(F.round("score", 9)), "id").limit(5)
    assert [(x["id"], round(x["score"], 9)) for x in got.collect()] == [(x["id"], round(x["score"], 9)) for x in want.collect()]


def moody(path: str) -> Embedder:
    """An embedder that fails for texts with a word that a file names; a class of its own, so that workers get it with the function."""

    class Moody(Embedder):
        provider, batch_size = "moody", 1

        def __init__(self, flag: str):
            self.flag, self.seen = flag, f"{flag}.seen"

        @property
        def dimension(self) -> int:
            return 1

        def embed_batch(self, texts):
            with open(self.flag) as f:
                word = f.read()
            if word and any(word in t for t in texts):
                raise RuntimeError("no answer")
            with open(self.seen, "a") as f:
                f.write("".join(json.dumps(t) + "\n" for t in texts))
            return np.ones((len(texts), 1))

    return Moody(path)


def test_failures_are_tried_again(spark, tmp_path):
    """A provider that fails for one of two files: the next sync whose time has come embeds exactly what is missing."""
    tree, flag = tmp_path / "tree", tmp_path / "flag"
    tree.mkdir()
    (tree / "a.py").write_text("def apple():\n    return 1\n")
    (tree / "b.py").write_text("def berry():\n    return 2\n")
    flag.write_text("berry")
    e = Engine(spark, str(tmp_path / "home"), moody(str(flag)), config=Config(hybrid=True, home=str(tmp_path), on_error="skip", retry_minutes=0.0))
    done = e.index(str(tree))
    name = e.collection_name(str(tree))
    assert done["total_chunks"] == 1 and [(r["relative_path"], r["attempts"]) for r in e.failed(str(tree)).collect()] == [("b.py", 1)]
    e.sync(str(tree))
    assert [(r["relative_path"], r["attempts"]) for r in e.failed(str(tree)).collect()] == [("b.py", 2)]
    flag.write_text("")
    os.remove(f"{flag}.seen")
    assert e.sync(str(tree)) == {"added": 0, "removed": 0, "modified": 0}
    assert e.failed(str(tree)).count() == 0 and sorted(r["relative_path"] for r in e.store.read(name).collect()) == ["a.py", "b.py"]
    assert [json.loads(x) for x in open(f"{flag}.seen")] == ["def berry():\n    return 2"]
    # what is not due yet waits, and a file that changes is done anew
    flag.write_text("cherry")
    e.config.retry_minutes = 60.0
    (tree / "b.py").write_text("def cherry():\n    return 3\n")
    assert e.sync(str(tree))["modified"] == 1 and e.store.count(name) == 1
    flag.write_text("")
    e.sync(str(tree))
    assert e.store.count(name) == 1 and e.failed(str(tree)).count() == 1
    (tree / "b.py").unlink()
    assert e.sync(str(tree))["removed"] == 1 and e.failed(str(tree)).count() == 0


def test_unreadable_file_keeps_its_chunks(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def apple():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=False, home=str(tmp_path)))
    e.index(str(tree))
    whole = e.tree
    monkeypatch.setattr(e, "tree", lambda path: whole(path).withColumns({"content": F.lit(None).cast("string"), "error": F.lit("no permission")}))
    assert e.sync(str(tree)) == {"added": 0, "removed": 0, "modified": 0}
    assert e.store.count(e.collection_name(str(tree))) == 1 and [(r["relative_path"], r["id"], r["error"]) for r in e.failed(str(tree)).collect()] == [("a.py", None, "no permission")]
    monkeypatch.undo()
    e.sync(str(tree))
    assert e.failed(str(tree)).count() == 0


def test_limit_errors_and_connection(spark, tmp_path):
    for n in ("one", "two"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "a.py").write_text("x = 1\n")
    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=False, home=str(tmp_path), most_collections=1))
    assert e.test_connection()
    e.index(str(tmp_path / "one"))
    with pytest.raises(LimitReached):
        e.index(str(tmp_path / "two"))
    assert e.status(str(tmp_path / "two")) == "indexfailed"
    from sablewick.plans.tools import Tools

    assert "limit of 1 collections" in Tools(e).call("index_codebase", {"path": str(tmp_path / "two")})
    # a failed sync stands in the status until one succeeds
    os.rename(tmp_path / "one", tmp_path / "gone")
    e.sync_all()
    message = lambda: e._status_table().filter("status = 'indexed'").first()["error_message"]
    assert "NotADirectoryError" in message()
    os.rename(tmp_path / "gone", tmp_path / "one")
    e.sync_all()
    assert message() is None


def test_status_file_of_vanished_trees(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps({"indexedCodebases": ["/here", "/gone"], "indexingCodebases": ["/half"]}))
    statuses = Versioned(spark, str(tmp_path / "s"), STATUS)
    assert migrated(spark, statuses, str(tmp_path / "v1.json"), lambda p: p == "/here") == ["/gone"]
    assert [r["codebase_path"] for r in statuses.load("status").collect()] == ["/here"]


def test_one_change_reads_one_path(spark):
    files = [(f"d{a}/e{b}/f{c}.py", f"{a}{b}{c}") for a in range(8) for b in range(8) for c in range(4)]
    old = sync.directory_nodes(spark.createDataFrame(files, "relative_path string, hash string")).cache()
    told: list[int] = []
    assert sync.changed_directories(old, old, told=told).count() == 0 and told == [1]  # ends at the root
    edited = [(p, "new" if p == "d3/e4/f1.py" else h) for p, h in files]
    told.clear()
    got = sync.changed_directories(old, sync.directory_nodes(spark.createDataFrame(edited, "relative_path string, hash string")), told=told)
    assert sorted(r["path"] for r in got.collect()) == ["", "d3", "d3/e4"] and told == [1, 8, 8, 0]
    many = sync.changed_directories(old, sync.directory_nodes(spark.createDataFrame([(p, h + "x") for p, h in files], "relative_path string, hash string")), few=3)
    assert many.count() == 1 + 8 + 64 and many.distinct().count() == 73


def test_change_log(spark, tmp_path):
    """Versions equal the differences of two states; offsets don't grow with the tree; nothing is read that didn't change."""
    tree = tmp_path / "tree"
    for n in range(300):
        (tree / f"d{n % 7}").mkdir(parents=True, exist_ok=True)
        (tree / f"d{n % 7}" / f"f{n}.py").write_text(f"x = {n}\n")
    log = ChangeLog(spark, str(tree), str(tmp_path / "log"))
    assert log.advance() == 1 and log.advance() == 1
    one = log.states.load("seen").select("relative_path", "hash")
    before = [tuple(r) for r in one.collect()]
    seen = []
    query = lambda: log.stream().writeStream.foreachBatch(lambda df, _: seen.append(sorted(map(tuple, df.select("relative_path", "change").collect())))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query().awaitTermination()
    assert len(seen) == 1 and len(seen[0]) == 300
    (tree / "d1" / "f1.py").write_text("changed\n")
    (tree / "d2" / "f2.py").unlink()
    (tree / "d3" / "new.py").write_text("new\n")
    os.utime(tree / "d4" / "f4.py", ns=(1, 1))  # touched, the same text
    assert log.advance() == 2
    assert spark.read.parquet(str(tmp_path / "log" / "scratch" / "read")).count() == 3
    query().awaitTermination()
    assert len(seen) == 2 and seen[1] == [("d1/f1.py", "modified"), ("d2/f2.py", "removed"), ("d3/new.py", "added")]
    two = log.states.load("seen").select("relative_path", "hash")
    diff = sync.snapshot_diff(spark.createDataFrame(before, "relative_path string, hash string"), two)
    assert sorted(map(tuple, diff.collect())) == seen[1]
    offsets = [(tmp_path / "cp" / "offsets" / str(k)).read_text() for k in range(2)]
    assert max(map(len, offsets)) < 1000 and '"logOffset"' in offsets[1]
