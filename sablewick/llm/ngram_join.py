"""N-gram Jaccard join with Bayesian candidate pruning.

All pairs of documents whose sets of five-word shingles have a Jaccard
similarity of at least ``threshold``:

1. Documents with equal sets are one class; only classes are compared.
2. Classes whose MinHash signatures agree in a whole band are candidates.  With
   24 bands of 4 a pair at 0.8 escapes with probability 3e-6.
3. A candidate bucket is cut into blocks by a hash, and pairs of blocks are cells
   of bounded size, so a bucket of any size is spread over many tasks without a
   row per pair.  A pair counts in the first band only in which it agrees.
4. In a cell signatures are compared a few hashes at a time; pairs whose
   posterior probability (uniform prior) of reaching the threshold falls below
   ``TOLERANCE`` are dropped.
5. The rest is verified exactly on the shingle sets, which travel only to cells
   in which they have a surviving pair.  A cell returns per class its number of
   links and one edge to its local component, not the pairs.

Defined results
---------------
* null text, and texts without words: the empty set, which has no links; such a
  document is a class of its own;
* texts of one to four words: one shingle of all their words;
* very long texts: whole; cells are also bounded in shingles;
* ties: a class is named by its smallest doc_id (null counts as smallest);
* repeated rows (same doc_id): each row counts as a document;
* empty table: no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sablewick.llm import common, components
from sablewick.llm.shingles import HASHES, set_key, shingle_sets, signatures

THRESHOLD, BANDS, ROWS = 0.8, 24, 4
STEP, TOLERANCE = 16, 1e-6
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 400_000

SKETCH = "doc_id long, set_key binary, n_set int, sig binary"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key and size of the shingle set, and signature."""

    def work(batch: pa.RecordBatch):
        for part in common.slices(batch, "text"):
            sets = shingle_sets(common.texts_of(part.column(1)))
            sig = signatures(sets)
            yield {"doc_id": part.column(0), "set_key": [set_key(s) for s in sets], "n_set": [len(s) for s in sets], "sig": [row.tobytes() for row in sig]}

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(SKETCH), work)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared hashes, the fewest matches with which a pair stays.

    With a uniform prior the similarity after m matches in n is Beta(m+1, n-m+1).
    """
    x = (np.arange(200_000) + 0.5) / 200_000
    above = x >= threshold
    out = []
    for n in range(HASHES + 1):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[above].sum() >= tolerance * p.sum():
                out.append(m)
                break
        else:
            out.append(n + 1)
    return tuple(out)


def cells(rows: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, from batches sorted by those."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        at = 0
        for stop in np.flatnonzero(new).tolist():
            if stop > at:
                held.append(batch.slice(at, stop - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], stop
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def by_cell(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """Bring equal ``keys`` together, sorted, and apply ``work`` to each run of rows."""
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    order = keys + [c for c in df.columns if c not in keys]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = df.select(*order).repartition(tasks, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for cell in cells(batches, len(keys)):
            done += work(cell)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return ready.mapInArrow(run, kind)


CELL = ["bucket", "i", "j"]
SURVIVOR = "bucket long, i int, j int, idx int, set_key binary, n_docs long, partners array<int>"
LINKED = "set_key binary, texts long, docs long, root binary"


def candidate_cells(classes: DataFrame) -> DataFrame:
    """Rows (bucket, i, j, block, band, set_key): who meets whom, in cells of bounded size."""
    names = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])
    bands = classes.select("set_key", "n_set", F.posexplode(names).alias("band", "bucket"))
    crowd = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_set").alias("shingles")).filter("n > 1")
    crowd = crowd.select(common.image(F.col("bucket"), "long").alias("k"), F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    met = bands.withColumn("k", common.image(F.col("bucket"), "long")).join(crowd, "k")
    met = met.withColumn("block", F.pmod(F.xxhash64("set_key", "bucket"), F.col("blocks")).cast("int"))
    return met.select("set_key", "bucket", "band", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "set_key"
    )


def prune(cell: pa.Table, threshold: float = THRESHOLD) -> list[tuple]:
    """The members of one cell that keep a pair, each with its partners."""
    m = cell.num_rows
    keys = cell["set_key"].to_pylist()
    order = sorted(range(m), key=keys.__getitem__)
    keys = [keys[o] for o in order]
    sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint32).reshape(m, HASHES)[order]
    block = np.asarray(cell["block"])[order]
    band, i, j = cell["band"][0].as_py(), cell["i"][0].as_py(), cell["j"][0].as_py()
    # Pairs inside a block belong to the cell (i, i), pairs across to (i, j).
    if i == j:
        a, b = np.triu_indices(m, 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == i), np.flatnonzero(block == j), indexing="ij"))
        a, b = np.minimum(a, b), np.maximum(a, b)
    groups = sig[:, : BANDS * ROWS].reshape(m, BANDS, ROWS)
    for k in range(band):  # an earlier band has this pair
        if not len(a):
            return []
        fresh = (groups[a, k] != groups[b, k]).any(axis=1)
        a, b = a[fresh], b[fresh]
    least, matches = least_matches(threshold), np.zeros(len(a), np.int64)
    for k in range(0, HASHES, STEP):
        if not len(a):
            return []
        matches += (sig[a, k : k + STEP] == sig[b, k : k + STEP]).sum(axis=1)
        stay = matches >= least[min(HASHES, k + STEP)]
        a, b, matches = a[stay], b[stay], matches[stay]
    if not len(a):
        return []
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    members, at = np.union1d(a, b), np.searchsorted(a, np.arange(m + 1))
    n_docs = np.asarray(cell["n_docs"])[sorted(range(m), key=cell["set_key"].to_pylist().__getitem__)]
    bucket = cell["bucket"][0].as_py()
    return [(bucket, i, j, int(x), keys[x], int(n_docs[x]), b[at[x] : at[x + 1]].tolist()) for x in members]


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(a) <= 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what one set alone holds adds to no intersection
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    width, total = 4096, np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column.max()) + 1 if len(column) else 0, width):
        here = (column >= k) & (column < k + width)
        table = np.zeros((len(sets), width), np.float32)
        table[owner[here], column[here] - k] = 1
        total += table @ table.T
    return total[a, b].astype(np.int64)


def verify(cell: pa.Table, threshold: float = THRESHOLD) -> list[tuple]:
    """Per class of one cell that has a true link: linked texts, linked documents, local root."""
    rows = {r["idx"]: r for r in cell.to_pylist()}
    number = {x: k for k, x in enumerate(sorted(rows))}
    members = [rows[x] for x in sorted(rows)]
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in members]
    pairs = [(number[x], number[y]) for x, r in rows.items() for y in r["partners"]]
    if not pairs:
        return []
    a, b = np.array(pairs).T
    both = overlaps(sets, a, b)
    size = np.array([len(s) for s in sets])
    near = both >= threshold * (size[a] + size[b] - both) - 1e-9
    a, b = a[near], b[near]
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    docs = np.array([r["n_docs"] for r in members])
    texts, linked = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
    np.add.at(texts, a, 1), np.add.at(texts, b, 1)
    np.add.at(linked, a, docs[b]), np.add.at(linked, b, docs[a])
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(members[x]["set_key"], int(texts[x]), int(linked[x]), members[find(x)]["set_key"]) for x in np.flatnonzero(texts).tolist()]


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, copies_id, n_links, n_text_links.

    ``class_id`` is the smallest doc_id of the documents connected by links,
    ``copies_id`` that of the documents with the same shingle set; ``n_links``
    counts linked documents (copies included), ``n_text_links`` linked sets.
    """
    sketch = common.written(sketches(docs), "sketches")
    classes = sketch.filter("n_set > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id"))).alias("least"), F.count("*").alias("n_docs"), F.first("n_set").alias("n_set"), F.first("sig").alias("sig")
    )
    classes = common.written(classes.select("set_key", F.col("least.doc_id").alias("copies_id"), "n_docs", "n_set", "sig"), "classes")
    met = candidate_cells(classes)
    full = met.join(classes.select("set_key", "n_docs", "sig"), "set_key")
    alive = common.written(by_cell(full, CELL, SURVIVOR, lambda cell: prune(cell, threshold)), "survivors")
    needed = alive.select("set_key").distinct().join(classes.select("set_key", "copies_id"), "set_key").select(F.col("copies_id").alias("__sw_id")).distinct()
    texts = docs.select("doc_id", "text").join(needed, F.col("doc_id").eqNullSafe(F.col("__sw_id")), "left_semi")

    def sets_of(batch: pa.RecordBatch):
        for part in common.slices(batch, "text"):
            sets = shingle_sets(common.texts_of(part.column(1)))
            yield {"set_key": [set_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    sets = common.map_batches(texts, _parse_datatype_string("set_key binary, shingles binary"), sets_of)
    checked = common.written(by_cell(alive.join(sets, "set_key"), CELL, LINKED, lambda cell: verify(cell, threshold)), "links")
    links = checked.groupBy("set_key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components.connected(checked.select(F.col("set_key").alias("u"), F.col("root").alias("v")))
    linked = links.join(roots, F.col("set_key") == F.col("u"), "left").select("set_key", "texts", "docs", F.coalesce("root", "set_key").alias("root"))
    known = common.written(classes.select("set_key", "copies_id", "n_docs").join(linked, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), "known")
    named = known.groupBy("root").agg(F.min(F.struct("copies_id")).alias("least")).select(F.concat(F.lit(b"="), F.col("root")).alias("k"), F.col("least.copies_id").alias("class_id"))
    full = known.withColumn("k", F.concat(F.lit(b"="), F.col("root"))).join(named, "k")
    full = full.select(F.concat(F.lit(b"="), F.col("set_key")).alias("k"), "class_id", "copies_id", "n_docs", "texts", "docs")
    return (
        sketch.select("doc_id", "n_set", F.concat(F.lit(b"="), F.col("set_key")).alias("k"))
        .join(full, "k", "left")
        .select(
            "doc_id",
            F.when(F.col("n_set") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.when(F.col("n_set") == 0, F.col("doc_id")).otherwise(F.col("copies_id")).alias("copies_id"),
            F.when(F.col("n_set") == 0, F.lit(0)).otherwise(F.col("n_docs") - 1 + F.coalesce("docs", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        )
    )


ORACLE_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y, c = p.n AND c = q.n AS same FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
  WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
class AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS class_id FROM documents d LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id),
copies AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.y), d.doc_id)) AS copies_id FROM documents d LEFT JOIN link l ON l.x = d.doc_id AND l.same GROUP BY d.doc_id)
SELECT d.doc_id, any_value(class.class_id) AS class_id, any_value(d.copies_id) AS copies_id, count(l.y) AS n_links,
       count(DISTINCT other.copies_id) FILTER (WHERE NOT l.same) AS n_text_links
FROM copies d JOIN class USING (doc_id) LEFT JOIN link l ON l.x = d.doc_id LEFT JOIN copies other ON other.doc_id = l.y
GROUP BY d.doc_id
"""
