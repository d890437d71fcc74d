"""Source trees, collections, the engine and streams, end to end on temporary folders."""

import base64
import os

import pytest
from pyspark.sql import functions as F

from sablewick.operators import evaluate, sync
from sablewick.plans.engine import Config, Engine
from sablewick.sources import github, state
from sablewick.sources.codefiles import read_tree
from sablewick.sources.store import Store
from sablewick.streaming.changes import Poller, event_counts

FILES = {"__init__.py": "x = 1\n", "_priv.py": "def hidden_helper():\n    return 'vector database'\n", "pkg/a.py": "def add(a, b):\n    return a + b\n", "pkg/b.ts": "export function sub(a, b) {\n  return a - b;\n}\n", "pkg/deep/er/c.md": "# Title\nabout the vector database\n", "node_modules/x.js": "no", "notes.txt": "no", "x.min.js": "no"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("# c\nignored\n")
    (root / "ignored").mkdir()
    (root / "ignored" / "z.py").write_text("z = 1")
    (root / "pkg" / "bad.py").write_bytes(b"\xff\xfe ok")
    os.symlink(root / "pkg", root / "link")
    return root


def names(df):
    return sorted(r[0] for r in df.select("relative_path").collect())


def test_source(spark, tree):
    got = read_tree(spark, str(tree))
    assert names(got) == ["__init__.py", "_priv.py", "ignored/z.py", "pkg/a.py", "pkg/b.ts", "pkg/bad.py", "pkg/deep/er/c.md"]
    assert got.filter("relative_path = 'pkg/bad.py'").first()["content"].startswith("\ufffd")
    assert names(got.filter("file_extension = '.ts'")) == ["pkg/b.ts"]
    assert names(read_tree(spark, str(tree), extensions=".txt")) == ["notes.txt"]


def test_engine(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=True, home=str(tmp_path)))
    assert e.search(str(tree), "x").count() == 0 and not e.has_index(str(tree)) and e.status(str(tree)) == "not_found"
    told = []
    done = e.index(str(tree), progress=lambda phase, percent: told.append(percent))
    assert done["status"] == "completed" and done["indexed_files"] == 6 and told[-1] == 100
    assert e.status(str(tree)) == "indexed"
    with pytest.raises(ValueError):
        e.index(str(tree))
    found = e.search(str(tree), "vector database", 3)
    assert found.columns == ["content", "relative_path", "start_line", "end_line", "language", "score"]
    assert {r["relative_path"] for r in found.collect()[:2]} == {"_priv.py", "pkg/deep/er/c.md"}
    assert set(names(e.search_tool(str(tree), "function", 99, [".ts"]))) == {"pkg/b.ts"}  # the statement and the function in it
    # sync: one edited, one new, one gone
    (tree / "pkg/a.py").write_text("def multiply(a, b):\n    return a * b\n")
    (tree / "pkg/new.py").write_text("def fresh():\n    pass\n")
    (tree / "_priv.py").unlink()
    assert e.sync(str(tree)) == {"added": 1, "modified": 1, "removed": 1}
    assert e.sync(str(tree)) == {"added": 0, "modified": 0, "removed": 0}
    rows = e.store.read(e.collection_name(str(tree)))
    again = Engine(spark, str(tmp_path / "other"), config=Config(home=str(tmp_path)))
    again.index(str(tree))
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(rows) == ids(again.store.read(again.collection_name(str(tree))))  # a synced index equals a fresh one
    e.store.drop(e.collection_name(str(tree)))
    assert e.reconcile() == [str(tree)] and e.status(str(tree)) == "not_found"
    again.clear(str(tree))
    assert not again.has_index(str(tree))


def test_dense_mode(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=False, home=str(tmp_path)))
    e.index(str(tree), splitter="langchain")
    assert e.search(str(tree), "vector database", 5, threshold=2.0).count() == 0
    best = e.search(str(tree), "about the vector database", 1).first()
    assert best["relative_path"] == "pkg/deep/er/c.md" and best["score"] > 0.5


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create("c", 2)
    row = ("1", [1.0, 0.0], "text", "a.py", 1, 2, ".py", "{}")
    cols = "id string, vector array<float>, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string"
    s.insert("c", spark.createDataFrame([row, ("2", *row[1:])], cols))
    s.insert("c", spark.createDataFrame([("3", *row[1:])], cols))
    assert s.list() == ["c"] and s.count("c") == 3
    s.delete("c", ["2"])
    assert [r["id"] for r in s.query("c", columns=["id"]).collect()] == ["1", "3"] and s.query("c", F.col("id") == "3").count() == 1
    s.vacuum("c")
    assert s.count("c") == 2
    with pytest.raises(Exception, match="limit of its collection"):
        s.insert("c", spark.createDataFrame([("4", [1.0], *row[2:])], cols))
    assert s.count("c") == 2
    s.clear("c")
    assert s.count("c") == 0 and s.within_limit(2) and not s.within_limit(1)
    s.drop("c")
    assert s.list() == []


def test_poller(spark, tree, tmp_path):
    seen = []
    p = Poller(spark, str(tree), lambda df, n: seen.append(sorted((r["relative_path"], r["change"]) for r in df.collect())), str(tmp_path / "cp"), extensions=".ts")
    p.start(None).awaitTermination()
    assert seen[-1] == [("pkg/b.ts", "added")]
    (tree / "pkg/b.ts").write_text("let x = 1;")
    (tree / "pkg/d.ts").write_text("let y = 1;")
    p.start(None).awaitTermination()
    assert seen[-1] == [("pkg/b.ts", "modified"), ("pkg/d.ts", "added")]
    (tree / "pkg/d.ts").unlink()
    p.start(None).awaitTermination()
    assert seen[-1] == [("pkg/d.ts", "removed")]


def test_event_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    event_counts(stream, str(tmp_path / "cp"), "counted").awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_sync_cases(spark):
    at = lambda d: spark.createDataFrame(list(d.items()), "relative_path string, hash string")
    diff = {r["relative_path"]: r["change"] for r in sync.snapshot_diff(at({"a": "1", "b": "2", "c": "3"}), at({"a": "1", "b": "9", "d": "4"})).collect()}
    assert diff == {"d": "added", "c": "removed", "b": "modified"}
    one, two = at({"a": "1", "b": "2"}), at({"b": "2", "a": "1"})
    assert sync.merkle_root(one).first() == sync.merkle_root(two).first() and sync.bucketed_root(one).first() == sync.bucketed_root(two).first()
    assert sync.bucketed_root(one).first() != sync.bucketed_root(at({"a": "1", "b": "3"})).first()


def test_status_files(spark, tmp_path):
    (tmp_path / "v2.json").write_text('{"formatVersion":"v2","codebases":{"/a":{"status":"indexed","indexedFiles":3,"totalChunks":9,"indexStatus":"completed","lastUpdated":"2025-01-01T00:00:00Z"},"/b":{"status":"indexing","indexingPercentage":40}},"lastUpdated":"2025-01-01T00:00:00Z"}')
    (tmp_path / "v1.json").write_text('{"indexedCodebases":["/x","/y"],"indexingCodebases":["/z"],"lastUpdated":"2025-01-01T00:00:00Z"}')
    assert [(r["codebase_path"], r["indexed_files"]) for r in state.status_from_json(spark, str(tmp_path / "v2.json")).collect()] == [("/a", 3)]
    assert sorted(r["codebase_path"] for r in state.status_from_json(spark, str(tmp_path / "v1.json")).collect()) == ["/x", "/y"]


def test_registry(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), ("c", 4)], "id string, t int").selectExpr("id", "timestamp_seconds(t) AS indexed_at")
    assert [r["id"] for r in state.recent(rows, 2).collect()] == ["a", "c"]
    merged = state.upsert(rows.limit(1), spark.createDataFrame([("a", 9)], "id string, t int").selectExpr("id", "timestamp_seconds(t) AS indexed_at"), "id")
    assert merged.count() == 1


def test_github(spark):
    files = {"src/a.py": "print('ä')", "README.md": "# hi", "x.png": "no"}

    def get(path):
        if path.endswith("/repos/o/r"):
            return {"default_branch": "main"}
        if "/git/trees/" in path:
            return {"tree": [{"path": p, "type": "blob"} for p in files] + [{"path": "src", "type": "tree"}]}
        return {"content": base64.b64encode(files[path.split("/contents/")[1]].encode()).decode()}

    found = github.repo_files(spark, get, "o", "r")
    got = {r["relative_path"]: r["content"] for r in github.repo_contents(found, get, "o", "r").collect()}
    assert got == {"src/a.py": "print('ä')", "README.md": "# hi"}


def test_golden_metrics(spark):
    rows = [("both_1", ["/a"], ["a", "b"]), ("grep_1", ["x", "y"], ["a", "b"]), ("both_2", ["a", "x"], ["a", "b"]), ("grep_2", ["a", "x", "y", "z"], ["a", "b"]), ("none", [], ["a"])]
    got = {r["instance_id"]: (r["precision"], r["recall"], round(r["f1"], 4)) for r in evaluate.precision_recall_f1(spark.createDataFrame(rows, "instance_id string, hits array<string>, oracles array<string>")).collect()}
    assert got == {"both_1": (1.0, 0.5, 0.6667), "grep_1": (0, 0, 0), "both_2": (0.5, 0.5, 0.5), "grep_2": (0.25, 0.5, 0.3333), "none": (0, 0, 0)}


def test_patches_and_edits(spark):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n--- /dev/null\n--- a/x.py\ndiff --git a/y.py b/y.py\n"
    row = spark.createDataFrame([(patch,)], "p string").select(evaluate.oracle_files(F.col("p")).alias("o"), evaluate.patch_files(F.col("p")).alias("f")).first()
    assert row["o"] == ["x.py"] and row["f"] == ["x.py", "y.py"]
    said = [("i", 0, "Successfully modified file: /r/a.py\nnothing"), ("i", 1, "edit {'file_path': 'b.py'}\nSuccessfully modified file: /r/a.py")]
    got = evaluate.edited_files(spark.createDataFrame(said, "instance_id string, seq int, content string"), "/r").orderBy("pos").collect()
    assert [(r["pos"], r["path"]) for r in got] == [(0, "a.py"), (1, "b.py")]
    calls = spark.createDataFrame([("i", 0, "edit", '{"file_path":"a.py","old_string":"x","new_string":"y"}')], "instance_id string, seq int, tool string, arguments string")
    assert "-x" in evaluate.unified_diff(evaluate.edit_calls(calls)).first()["diff"]


def test_tools(spark, tree, tmp_path):
    from sablewick.plans.tools import Tools

    t = Tools(Engine(spark, str(tmp_path / "home"), config=Config(hybrid=True, home=str(tmp_path))))
    path = str(tree)
    assert "not indexed" in t.call("get_indexing_status", {"path": path}) and "not indexed" in t.call("search_code", {"path": path, "query": "x"})
    assert "Error" in t.call("nothing", {}) and "Error" in t.call("index_codebase", {"path": path + "/none"}) and "Error" in t.call("index_codebase", {"path": path, "splitter": "x"})
    assert "Started" in t.call("index_codebase", {"path": path, "customExtensions": ["txt"]})
    t.wait(path)
    assert "7 files" in t.call("get_indexing_status", {"path": path})
    assert "indexed already" in t.call("index_codebase", {"path": path})
    assert "pkg/b.ts:1-" in t.call("search_code", {"path": path, "query": "function", "extensionFilter": [".ts"]})
    assert "Error" in t.call("search_code", {"path": path, "query": "x", "extensionFilter": ["ts"]})
    assert "Cleared" in t.call("clear_index", {"path": path}) and "Error" in t.call("clear_index", {"path": path})


def test_settings(tmp_path, monkeypatch):
    from sablewick.plans.engine import save_setting, setting

    save_setting("A_NAME", "1", str(tmp_path))
    save_setting("B_NAME", "x=y", str(tmp_path))
    save_setting("A_NAME", "2", str(tmp_path))
    assert setting("A_NAME", home=str(tmp_path)) == "2" and setting("B_NAME", home=str(tmp_path)) == "x=y" and setting("C_NAME", "d", str(tmp_path)) == "d"
    monkeypatch.setenv("A_NAME", "3")
    assert setting("A_NAME", home=str(tmp_path)) == "3"


def test_repo_index_and_registry(spark, tmp_path):
    text = "def cache_filler():\n    return 'fills the cache'\n" * 5

    def get(path):
        if path.endswith("/repos/o/r"):
            return {"default_branch": "main"}
        if "/git/trees/" in path:
            return {"tree": [{"path": "src/a.py", "type": "blob"}]}
        return {"content": base64.b64encode(text.encode()).decode()}

    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=True, home=str(tmp_path)))
    done = e.index_repo(get, "o", "r")
    assert done == {"collection": "chrome_repo_o_r", "total_chunks": 1}
    assert e.search_collection("chrome_repo_o_r", "cache").first()["relative_path"] == "src/a.py" and e.search_collection("none", "x").count() == 0
    reg = state.Registry(spark, str(tmp_path / "reg"), keep=2)
    row = lambda i, t: spark.createDataFrame([(i, t)], "id string, t int").selectExpr("id", "timestamp_seconds(t) AS indexed_at")
    for i, t in (("a", 1), ("b", 2), ("c", 3), ("b", 9)):
        reg.add(row(i, t))
    assert [r["id"] for r in reg.rows().orderBy("id").collect()] == ["b", "c"]
    reg.touch("b")
    assert reg.find("b").first()["last_search_at"] is not None
    reg.remove("c")
    assert reg.rows().count() == 1


def test_result_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"instance_id":"i","hits":["/a"],"oracles":["a","b"],"token_usage":{"total_tokens":5},"tool_stats":{"tool_call_counts":{"edit":2},"total_tool_calls":2}}')
    rows = evaluate.read_results(spark, str(tmp_path / "r.json"))
    assert rows.first()["tool_stats"]["tool_call_counts"] == {"edit": 2}
    assert evaluate.precision_recall_f1(rows).first()["recall"] == 0.5
    assert evaluate.subset_statistics(rows, rows.union(rows).union(rows)).first()["percent"] == 33.3


def test_edit_during_a_run_is_found_later(spark, tree, tmp_path):
    """A file edited after the scan keeps its old hash with its old chunks, so the next sync takes it."""
    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=False, home=str(tmp_path)))

    def edit(phase, percent):
        if phase == "Indexing":
            (tree / "pkg/a.py").write_text("def edited_meanwhile():\n    return 1\n")

    e.index(str(tree), progress=edit)
    assert not e.store.read(e.collection_name(str(tree))).filter("content LIKE '%edited_meanwhile%'").count()
    assert e.sync(str(tree)) == {"added": 0, "removed": 0, "modified": 1}
    assert e.store.read(e.collection_name(str(tree))).filter("content LIKE '%edited_meanwhile%'").count() == 1
    assert e.file_hash(str(tree), "pkg/a.py") == __import__("hashlib").sha256((tree / "pkg/a.py").read_bytes()).hexdigest()
    assert e.file_hash(str(tree), "none.py") is None and not (tmp_path / "home" / "scratch").exists() or not list((tmp_path / "home" / "scratch").iterdir())


def test_searchable_while_indexing(spark, tree, tmp_path):
    """Chunks are committed in steps; what is committed is found before the run ends, and progress is saved."""
    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=True, home=str(tmp_path), commit_chunks=2))
    seen = []

    def tell(phase, percent):
        name = e.collection_name(str(tree))
        seen.append((phase, percent, e.store.count(name) if e.store.has(name) else None))

    done = e.index(str(tree), progress=tell)
    counts = [n for phase, _, n in seen if phase == "Indexing"]
    assert len(counts) > 1 and counts[0] == 0 and counts == sorted(counts) and seen[-1][2] == done["total_chunks"] == e.store.count(e.collection_name(str(tree)))
    assert [p for _, p, _ in seen] == sorted(p for _, p, _ in seen)


def test_reader_during_a_commit_and_two_writers(spark, tmp_path):
    from sablewick.sources.store import Conflict

    s = Store(spark, str(tmp_path / "s"))
    s.create("c", 1)
    cols = "id string, vector array<float>, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string"
    rows = lambda *names: spark.createDataFrame([(n, [1.0], f"text of {n}", "a.py", 1, 2, ".py", "{}") for n in names], cols)
    s.insert("c", rows("1", "2"))
    reading = s.read("c")
    s.replace("c", rows("3"))
    assert sorted(r["id"] for r in reading.select("id").collect()) == ["1", "2"]  # the version it began with
    assert [r["id"] for r in s.read("c").collect()] == ["3"] and s.totals("c") == (1, 3)
    assert sorted(r["term"] for r in s.postings("c").collect()) == ["3", "of", "text"]
    at, about = s._current("c")
    s.insert("c", rows("4"))
    with pytest.raises(Conflict):  # another writer that began before
        Store(spark, str(tmp_path / "s"))._pointer("c").move(at, about | {"version": "x", "parts": []})
    assert s.count("c") == 2 and s.ready("c") and not s.ready("none", wait=0.1)
    with pytest.raises(Exception, match="limit of its collection"):
        s.replace("c", rows("5").selectExpr("id", "array(1f, 2f) AS vector", "content", "relative_path", "start_line", "end_line", "file_extension", "metadata"))
    # the pointer is never absent while it moves
    import threading

    from sablewick.sources.store import Pointer

    pointer, seen, stop = Pointer(s.files, str(tmp_path / "p"), "x"), [], threading.Event()
    pointer.move(0, {"k": 0})

    def look():
        while not stop.is_set():
            seen.append(pointer.read()[1]["k"])

    watcher = threading.Thread(target=look)
    watcher.start()
    for k in range(1, 60):
        pointer.move(k, {"k": k})
    stop.set()
    watcher.join()
    assert len(seen) > 20 and seen == sorted(seen) and pointer.read() == (60, {"k": 59})


def test_sync_all_isolates_errors(spark, tree, tmp_path):
    import shutil
    import time

    other = tmp_path / "other"
    shutil.copytree(tree, other, symlinks=True)
    e = Engine(spark, str(tmp_path / "home"), config=Config(hybrid=True, home=str(tmp_path)))
    e.index(str(tree))
    e.index(str(other))
    shutil.rmtree(other)
    (tree / "pkg/new.py").write_text("def brand_new_thing():\n    pass\n")
    done = e.sync_all()
    assert done[str(tree)] == {"added": 1, "removed": 0, "modified": 0} and "NotADirectoryError" in done[str(other)]
    assert e.search(str(tree), "brand_new_thing", 1).first()["relative_path"] == "pkg/new.py"
    (tree / "pkg/new.py").unlink()
    told = []
    polling = e.poll(str(tmp_path / "poll"), minutes=1 / 60, told=told.append)
    until = time.time() + 60
    while not any(str(tree) in t and t[str(tree)] == {"added": 0, "removed": 1, "modified": 0} for t in told) and time.time() < until:
        time.sleep(0.2)
    polling.stop()
    assert any(t[str(tree)] == {"added": 0, "removed": 1, "modified": 0} for t in told)


def test_embedding_failures(spark):
    import numpy as np

    from sablewick.functions.embed import Embedder, RemoteEmbedder

    class Picky(Embedder):
        dimension, batch_size = 1, 2

        def embed_batch(self, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return np.array([[len(t)] for t in texts], float)

    df = spark.createDataFrame([("a",), ("bb",), ("bad",), ("cc",), ("ddd",)], "t string").coalesce(1)
    got = [(r["t"], r["v"]) for r in df.select("t", Picky().column("skip")(F.col("t")).alias("v")).collect()]
    assert got == [("a", [1.0]), ("bb", [2.0]), ("bad", None), ("cc", None), ("ddd", [3.0])]
    with pytest.raises(Exception, match="no"):
        df.select(Picky().column()(F.col("t"))).collect()
    with pytest.raises(ValueError):
        Picky().column("ignore")
    long = RemoteEmbedder("OpenAI", lambda texts, model: [[0.0] * 3072 for _ in texts])
    with pytest.raises(ValueError, match="vectors of 3072"):
        long.embed("x")
    assert len(RemoteEmbedder("Gemini", lambda texts, model: [[0.0] * 3072 for _ in texts], dimension=768).embed("x")) == 768


def test_registry_forgets_lost_collections(spark, tmp_path):
    book = state.Registry(spark, str(tmp_path / "book"))
    rows = spark.createDataFrame([("a", "c_a", 1), ("b", "c_b", 2)], "id string, collection_name string, t int").selectExpr("id", "collection_name", "timestamp_seconds(t) AS indexed_at")
    book.add(rows)
    assert book.reconcile(lambda name: name == "c_a") == ["b"] and [r["id"] for r in book.rows().collect()] == ["a"]
    assert book.reconcile(lambda name: True) == []


def test_drop_ratio_and_stored_scores(spark, tmp_path):
    from sablewick.operators import search

    assert search.kept_terms({"a": 1.0, "b": 3.0, "c": 2.0, "d": 4.0}, 0.5) == ["b", "d"] and search.kept_terms({"a": 1.0}, 1.0) == ["a"] and search.kept_terms({}, 0.5) == []
    s = Store(spark, str(tmp_path / "s"))
    s.create("c", 1)
    cols = "id string, vector array<float>, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string"
    texts = {"1": "red fox fox", "2": "red dog", "3": "", "4": "grey cat"}
    s.insert("c", spark.createDataFrame([(i, [1.0], t, "a.py", 1, 2, ".py", "{}") for i, t in texts.items()], cols))
    stored = {r["id"]: round(r["score"], 9) for r in search.bm25_stored(s.postings("c"), s.totals("c"), "red fox").collect()}
    plain = {r["id"]: round(r["score"], 9) for r in search.bm25(s.read("c"), "red fox").collect()}
    assert stored == plain and set(stored) == {"1", "2"}
    assert search.bm25_stored(s.postings("c"), s.totals("c"), "none such").count() == 0


def test_grep_patterns_hold_per_line(spark):
    files = spark.createDataFrame([("a", "x\nstart here\nend")], "relative_path string, content string")
    assert [r["line_number"] for r in evaluate.grep(files, r"\Astart").collect()] == [2]
    assert [r["line_number"] for r in evaluate.grep(files, r"here\z").collect()] == [2]


def test_access_checks():
    answers = {"/user": (200, {}, {}), "/repos/o/r": (200, {}, {"full_name": "o/r", "private": False, "default_branch": "main", "x": 1})}
    assert github.check_access(answers.__getitem__, "o", "r", True) == {"full_name": "o/r", "private": False, "default_branch": "main"}
    for status, headers, error in ((401, {}, github.NoAccess), (404, {}, github.NoAccess), (500, {}, github.NoAccess), (403, {}, github.NoAccess), (403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "7"}, github.RateLimited)):
        with pytest.raises(error):
            github.check_access(lambda path: (status, headers, {}), "o", "r")  # noqa: B023


def test_providers():
    from sablewick.functions import embed

    seen = []
    fetch = lambda *a: seen.append(a) or [[0.0] * 1024 for _ in a[0]]
    v = embed.embedder_from({"EMBEDDING_PROVIDER": "VoyageAI", "EMBEDDING_MODEL": "voyage-2"}.get, fetch)
    assert (v.dimension, v.max_tokens, len(embed.VOYAGE_DIMENSIONS)) == (1024, 4000, 18) and len(v.embed("x")) == 1024 and seen[-1][2] == "document"
    assert [embed.PROVIDERS["VoyageAI"].tokens_of(m) for m in ("voyage-3", "voyage-large-2-instruct", "voyage-lite-02-instruct", "voyage-01", "voyage-law-2")] == [32000, 16000, 4000, 4000, 16000]
    o = embed.embedder_from({"EMBEDDING_PROVIDER": "Ollama", "OLLAMA_MODEL": "snowflake-arctic-embed2", "EMBEDDING_MODEL": "x"}.get, fetch)
    assert (o.model, o.max_tokens) == ("snowflake-arctic-embed2", 8192)
    assert embed.embedder_from({}.get, fetch).provider == "OpenAI" and embed.embedder_from({"EMBEDDING_PROVIDER": "hash"}.get, fetch).provider == "hash"
