"""Line dedup, exact dedup and the n-gram join against brute force."""

import hashlib
import itertools
import random
import re
import uuid
from collections import Counter

import duckdb
import pytest

from sablewick.llm import common, components, queries, stages
from sablewick.llm.exact_dedup import UPPER, DigestIndex, exact_dedup, keep_one
from sablewick.llm.line_dedup import fingerprints, line_dedup, line_dedup_digest, matches
from sablewick.llm.ngram_join import BANDS, least_matches, jaccard_join, overlaps
from sablewick.sources.store import Conflict

TABLES = "documents labels conversations embeddings".split()


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


# ---------------------------------------------------------------- lines


def brute_lines(docs: list[tuple], window: int) -> dict:
    """Remaining text by (doc_id, text): a line goes if a window over it has an earlier equal one."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    first: dict[tuple, tuple] = {}
    out = {}
    for place, (doc_id, text) in enumerate(order):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - window + 1):
            win = tuple(lines[k : k + window])
            if not any(x.strip(" ") for x in win):
                continue
            if first.setdefault(win, (place, k)) != (place, k):
                gone.update(range(k, k + window))
        out[doc_id, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup_brute(spark, window):
    r = random.Random(window)
    docs = [(i, "\n".join(r.choice(["a", "b", "c", "d", "", " "]) for _ in range(r.randint(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(x["doc_id"], dict(docs)[x["doc_id"]]): x["text"] for x in line_dedup(df, window).collect()}
    assert got == brute_lines(docs, window)


def test_line_dedup_awkward(awkward, nothing):
    rows = line_dedup_digest(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_lines"] == 1 and by[3]["n_removed"] == 0 and by[5]["n_removed"] == 0
    assert by[12]["removed"] == "1-3" and by[11]["n_removed"] == 0
    # the repeated row of document 9 is one place, and its text repeats document 8
    assert [r["n_removed"] for r in rows if r["doc_id"] == 9] == [120, 120] and by[8]["n_removed"] == 0
    assert line_dedup_digest(nothing).count() == 0


def test_matches_are_maximal(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nq\nd\ne"), (4, "x\nb\nr"), (5, "b\nc\nb\nc\nb")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((m["doc"], m["first"], m["last"], m["origin_doc"], m["origin_first"]) for m in matches(df).collect())
    assert got == [(2, 1, 3, 1, 1), (3, 0, 1, 1, 0), (3, 3, 4, 1, 3), (4, 0, 1, 2, 0), (5, 0, 1, 1, 1), (5, 2, 3, 1, 1), (5, 3, 4, 5, 1)]


def test_winnowing_is_guaranteed(spark):
    """Every window selects one of its lines, and fewer lines are selected the wider it is."""
    r = random.Random(8)
    text = "\n".join(f"{r.random()}" for _ in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for window in (2, 5, 9):
        found = fingerprints(df, window).collect()
        assert sorted(w["at"] for f in found for w in f["windows"]) == list(range(3000 - window + 1))
        assert all(w["at"] <= f["line"] < w["at"] + window for f in found for w in f["windows"])
        assert abs(len(found) / 3000 - 2 / (window + 1)) < 0.05


def test_long_repeats_take_linear_time(spark):
    """20,000 equal lines, and a copy: seconds, not a square of the lines."""
    import time

    docs = [(1, "same line\n" * 20000), (2, "\n".join(f"line {k}" for k in range(20000))), (3, "\n".join(f"line {k}" for k in range(20000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_removed"], r["removed"]) for r in line_dedup_digest(df, long_lines=True).collect()}
    assert got == {1: (19999, "1-19999"), 2: (0, ""), 3: (20000, "0-19999")}
    assert time.perf_counter() - began < 60


def test_line_dedup_long_lines(spark, nothing):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    long, short, unspaced = words(51), words(50), "\u6587" * 301
    docs = [(1, long), (2, f"a\n{long}\nb"), (3, long), (4, short), (5, short), (6, unspaced), (7, unspaced), (8, " " * 400), (9, " " * 400), (10, f"{long}\n{long}\nc")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["removed"] for r in line_dedup_digest(df, long_lines=True).collect()}
    assert got == {1: "", 2: "1-1", 3: "0-0", 4: "", 5: "", 6: "", 7: "0-0", 8: "", 9: "", 10: "0-1"}
    assert line_dedup_digest(nothing, long_lines=True).count() == 0


# ---------------------------------------------------------------- exact


def name() -> str:
    return f"test_digests_{uuid.uuid4().hex}"


def test_exact_dedup_awkward(spark, awkward, nothing):
    index = DigestIndex(spark, name())
    rows = exact_dedup(awkward, index).collect()
    assert len(rows) == awkward.count()
    low = lambda t: (t or "").translate(str.maketrans(UPPER, UPPER.lower()))
    texts = [(r["doc_id"], low(r["text"])) for r in awkward.collect()]
    groups = Counter(t for _, t in texts)
    for r in rows:
        mine = [t for i, t in texts if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == groups[mine[0]]
        assert r["keep_id"] == max((i for i, t in texts if t == mine[0] and i is not None), default=None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert index.read().count() == len(groups)
    assert exact_dedup(nothing, index).count() == 0 and index.read().count() == len(groups)
    index.drop()


def test_index_persists(spark):
    index = DigestIndex(spark, name())
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    exact_dedup(rows((1, "a"), (2, "A"), (3, "b")), index)
    again = DigestIndex(spark, index.name)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(rows((9, "a"), (8, "c"), (7, "c")), again).collect()}
    assert got == {9: (2, 1, False), 8: (8, 2, True), 7: (8, 2, False)}
    assert index.read().count() == 3
    index.drop()


def test_batches_and_retries(spark):
    """Three batches of one text; each counts its own rows, and running one again changes nothing."""
    index = DigestIndex(spark, name())
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    batches = [rows((1, "a"), (2, "A"), (5, "b")), rows((3, "a")), rows((4, "a"), (6, "c"), (6, "c"))]
    run = lambda batch: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(batch, index).collect())
    once = [run(b) for b in batches]
    assert once == [[(1, 2, 2, False), (2, 2, 2, True), (5, 5, 1, True)], [(3, 2, 1, False)], [(4, 2, 1, False), (6, 6, 2, True), (6, 6, 2, True)]]
    before = sorted(map(tuple, index.read().collect()))
    assert [run(b) for b in batches] == once and sorted(map(tuple, index.read().collect())) == before
    index.drop()


def test_query_leaves_no_index(spark, sf_dir):
    before = {t.name for t in spark.catalog.listTables()}
    assert queries.op2_exact_dedup(spark, sf_dir).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_index_opens_by_path(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index = DigestIndex(spark, name(), 4, str(tmp_path / "index"))
    assert exact_dedup(rows, index).count() == 2
    index.drop()  # the catalogue forgets the table, its files stay
    again = DigestIndex(spark, name(), 4, str(tmp_path / "index"))
    assert again.read().count() == 2
    assert not exact_dedup(rows.withColumn("doc_id", rows.doc_id + 5), again).first()["kept"]
    again.drop()


def test_index_plan_is_merge_and_bucketed(spark):
    index = DigestIndex(spark, name(), 4)
    known = index.read().select("text_sha256").hint("merge")
    groups = spark.createDataFrame([("x", 1)], "text_sha256 string, keep_id long")
    plan = groups.hint("merge").join(known, "text_sha256", "left_anti")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "SortMergeJoin" in physical and "Bucketed: true" in physical and physical.count("Exchange hashpartitioning") == 1
    index.drop()


def test_keep_one(spark, awkward):
    index = DigestIndex(spark, name())
    kept = keep_one(awkward, index)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert len(ids) == len(set(ids)) == index.read().count()
    index.drop()


# ---------------------------------------------------------------- n-gram join


def brute_links(docs: dict) -> dict:
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: set() for i in docs}
    for a, b in itertools.combinations(docs, 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b), links[b].add(a)
    return links


def classes_of(links: dict) -> dict:
    out = {}
    for i in sorted(links):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = i
                stack += links[x]
    return out


def check_join(df):
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    links = brute_links(docs)
    want = classes_of(links)
    rows = jaccard_join(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["class_id"], r["n_links"]) == (want[r["doc_id"]], len(links[r["doc_id"]])), r


def test_join_on_documents(spark, sf_dir):
    check_join(common.table(spark, sf_dir, "documents"))


def test_join_hot_group(spark):
    """700 near copies (several blocks), 300 exact copies, and a chain that only neighbours link."""
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(700):
        t = list(base)
        t[i % 100] = f"x{i}"
        docs.append((i, " ".join(t)))
    docs += [(1000 + i, "copy of the very same text " * 3) for i in range(300)]
    for i in range(30):
        docs.append((2000 + i, " ".join(f"c{k}" for k in range(i * 8, i * 8 + 150))))
    check_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))


def test_join_awkward(spark, awkward, nothing):
    rows = jaccard_join(awkward).collect()
    assert len(rows) == awkward.count() and jaccard_join(nothing).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_links"] == 0 and by[3]["class_id"] == 3 and by[4]["class_id"] == 4
    assert by[6]["class_id"] == by[7]["class_id"] == 6
    assert by[0]["class_id"] is None and by[2]["class_id"] is None  # a copy with a null id is the smallest
    assert by[9]["class_id"] == 8 and by[9]["n_links"] == 2


def test_pruning_table_and_overlaps():
    import numpy as np

    least = least_matches()
    assert least[0] == 0 and all(a <= b for a, b in zip(least, least[1:])) and least[96] < 0.8 * 96 and BANDS * 4 == 96
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 400, 200)).astype(np.uint64) for _ in range(20)]
    a, b = np.triu_indices(20, 1)
    assert overlaps(sets, a, b).tolist() == [len(set(sets[x]) & set(sets[y])) for x, y in zip(a, b)]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(400, 400 + k) for k in range(1, 80)]
    code = lambda k: k.to_bytes(4)
    df = spark.createDataFrame([(bytearray(code(a)), bytearray(code(b))) for a, b in edges], "u binary, v binary")
    links = {v: set() for e in edges for v in e}
    for a, b in edges:
        links[a].add(b), links[b].add(a)
    want = classes_of(links)
    got = {int.from_bytes(x["u"]): int.from_bytes(x["root"]) for x in components.connected(df).collect()}
    assert got == {v: c for v, c in want.items() if v != c}


def test_drop_near_copies(spark, awkward):
    kept = stages.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 7 not in ids and 6 in ids and 2 not in ids and {3, 4, 5} <= ids


def test_index_of_two_writers(spark):
    """A digest that was appended twice gives each row once; a second writer is told; compaction leaves a file for each bucket."""
    name = f"digests_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, 2)
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    for _ in range(3):
        index._append(exact_dedup(docs, index).groupBy("text_sha256").agg({"keep_id": "max"}).withColumnRenamed("max(keep_id)", "keep_id"))
    got = exact_dedup(docs, index).collect()
    assert len(got) == 40 and {r["keep_id"] for r in got} == set(range(33, 40))
    with index.alone(), pytest.raises(Conflict):
        index.add(docs.selectExpr("sha2(text, 256) AS text_sha256", "doc_id AS keep_id"))
    with pytest.raises(Conflict):  # the first writer counts as lost, and is told so when it ends
        with index.alone(), DigestIndex(spark, name, 2).alone(patience=-1):
            pass
    index.drop()


def test_index_compaction(spark):
    name = f"digests_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, 2)
    for k in range(3):
        exact_dedup(spark.createDataFrame([(i, f"text {i}") for i in range(k * 50, k * 50 + 80)], "doc_id long, text string"), index)
    before = sorted(map(tuple, index.read().collect()))
    assert len(spark.table(name).inputFiles()) > 2
    index.compact()
    assert sorted(map(tuple, index.read().collect())) == before and len(before) == 180
    assert len(spark.table(name).inputFiles()) == 2
    got = exact_dedup(spark.createDataFrame([(1000, "text 5"), (1001, "new")], "doc_id long, text string"), index).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(1000, 5), (1001, 1001)}
    index.drop()
