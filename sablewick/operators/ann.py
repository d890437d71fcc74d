"""Approximate nearest vectors from a stored inverted-file index with product codes.

``VectorIndex.build`` cuts the unit sphere into cells around centres, stores each
vector in the folder of its nearest centre, and beside it a code: for each part of
the vector, the number of the entry nearest to what the centre leaves over.  A
search compares a query with the centres and reads the ``probe`` nearest cells only
(the scan is pruned to their folders).  In each record batch all codes are scored
by one table look-up for each part, and the best ``shortlist`` for each result,
with all that are tied with the last of them, get their exact cosine; a task keeps
the ``k`` best of each query.

Centres and entries are fitted in numpy on a sample of bounded size
(``SAMPLE_ROWS``, the vectors whose ids have the smallest hashes); every vector is
then assigned and stored.  Cells grow with the square root of the rows up to
``MOST_CELLS``, so what tasks are sent has a bound, and a cell that holds a large
share of all rows is written by several tasks.  How many cells a search reads is
measured when the index is built: as many as hold ``COVERED`` of the nearest
neighbours of sampled vectors within the sample.  That is few where vectors lie
in clusters, and most where they have no structure that could be used.

Vectors that are null, empty, zero, not finite or of another length than the
index's have no direction: they are stored in cell -1, which no search reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sablewick.operators.search import QUERY_BLOCK, dense_topk
from sablewick.sources.store import Files, Store

MOST_CELLS, SAMPLE_ROWS, PARTS, ENTRIES = 4096, 65_536, 8, 256
#: Share of nearest neighbours whose cells a search reads, as measured for so many; candidates ranked again for each result.
COVERED, MEASURED, NEIGHBOURS, SHORTLIST = 0.985, 256, 10, 20


def units(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and those as rows of length 1."""
    lists = column.cast(pa.list_(pa.float32()))
    fits = np.diff(np.asarray(lists.offsets)) == dimension
    fits &= np.asarray(lists.is_valid())
    flat = np.asarray(lists.filter(pa.array(fits)).flatten().fill_null(np.nan), np.float32).reshape(-1, dimension)
    with np.errstate(invalid="ignore", over="ignore"):
        length = np.sqrt((flat.astype(np.float64) ** 2).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    fits[np.flatnonzero(fits)[~good]] = False
    return fits, (flat[good] / length[good, None]).astype(np.float32)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each point."""
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = (points[at : at + 4096] @ centres.T - half).argmax(axis=1)
    return out


def best_of(near: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the ``most`` largest scores are; of equal scores at the edge, those with the smallest ids."""
    if len(near) <= most:
        return np.arange(len(near))
    edge = -np.partition(-near, most - 1)[most - 1]
    above, tied = np.flatnonzero(near > edge), np.flatnonzero(near == edge)
    if len(above) + len(tied) > most:
        tied = tied[np.asarray(pc.sort_indices(pa.array(ids[tied].tolist())))][: most - len(above)]
    return np.concatenate([above, tied])


def k_means(points: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of at most ``k`` clusters; one that loses all of its points begins again at a point of the largest."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros(centres.shape, np.float64)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
        for empty in np.flatnonzero(count == 0):
            centres[empty] = points[rng.choice(np.flatnonzero(own == count.argmax()))]
    return centres


class Model:
    """Centres, and for each part the entries that stand for what centres leave over."""

    def __init__(self, centres: np.ndarray, entries: list[np.ndarray], probe: int = 1):
        self.centres, self.entries, self.probe = centres, entries, probe
        self.cuts = np.cumsum([0, *(e.shape[1] for e in entries)])

    @classmethod
    def fitted(cls, sample: np.ndarray, cells: int, parts: int) -> Model:
        centres = k_means(sample, cells)
        rest = sample - centres[nearest(sample, centres)]
        model = cls(centres, [k_means(np.ascontiguousarray(part), ENTRIES) for part in np.array_split(rest, min(parts, sample.shape[1]), axis=1)])
        model.probe = model.measured(sample)
        return model

    def cells_by_nearness(self, queries: np.ndarray) -> np.ndarray:
        """All cells, the nearest first, for each query."""
        near = queries @ self.centres.T - (self.centres * self.centres).sum(axis=1) / 2
        return np.argsort(-near, axis=1, kind="stable")

    def measured(self, sample: np.ndarray) -> int:
        """The number of nearest cells in which ``COVERED`` of the nearest neighbours lie, for some of the sample; copies count once, since theirs are easy to find."""
        sample = np.unique(sample, axis=0)
        sample = sample[np.random.default_rng(7).permutation(len(sample))]
        asked = sample[:MEASURED]
        near = asked @ sample.T
        near[np.arange(len(asked)), np.arange(len(asked))] = -2
        k = min(NEIGHBOURS, len(sample) - 1)
        if not k:
            return 1
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = np.argsort(self.cells_by_nearness(asked), axis=1)  # of each cell, from 0
        places = np.sort(np.take_along_axis(place, nearest(sample, self.centres)[best], axis=1), axis=None)
        return int(places[min(len(places) - 1, int(len(places) * COVERED))]) + 1

    def coded(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each point."""
        cell = nearest(points, self.centres)
        rest = points - self.centres[cell]
        parts = [nearest(np.ascontiguousarray(rest[:, a:b]), e) for a, b, e in zip(self.cuts, self.cuts[1:], self.entries)]
        return cell, np.stack(parts, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query, part and entry, what the entry adds to the score."""
        out = np.zeros((len(queries), len(self.entries), ENTRIES), np.float32)
        for p, (a, b, e) in enumerate(zip(self.cuts, self.cuts[1:], self.entries)):
            out[:, p, : len(e)] = queries[:, a:b] @ e.T
        return out

    def to_json(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "entries": [e.tolist() for e in self.entries], "probe": self.probe})

    @classmethod
    def from_json(cls, text: str) -> Model:
        read = json.loads(text)
        return cls(np.array(read["centres"], np.float32), [np.array(e, np.float32) for e in read["entries"]], read["probe"])


class VectorIndex:
    """An index in one folder: ``model.json``, ``schema.json`` and the rows (id, code, vector) by cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def exists(self) -> bool:
        return self.files.exists(f"{self.path}/model.json")

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, id_col: str = "id", vector_col: str = "vector", cells: int | None = None, parts: int = PARTS) -> VectorIndex:
        """Index every row (id, vector); the model is written last, so an index that can be opened is complete."""
        index = cls(rows.sparkSession, path)
        rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        first = rows.filter("size(vector) > 0").select(F.size("vector").alias("n")).first()
        dimension = first["n"] if first else 1
        total = rows.count()
        hashed = F.xxhash64("id")
        some = rows.filter("size(vector) > 0")
        if total > 2 * SAMPLE_ROWS:  # about 1.5 samples pass, so what is ordered does not grow with the rows
            some = some.filter(hashed < F.lit(-(1 << 63) + int((1 << 64) * 1.5 * SAMPLE_ROWS / total)))
        sample = units(some.orderBy(hashed, "id").limit(SAMPLE_ROWS).select("vector").toArrow().column(0).combine_chunks(), dimension)[1]
        model = Model.fitted(sample, cells or max(1, min(MOST_CELLS, int(total**0.5))), parts) if len(sample) else Model(np.zeros((1, dimension), np.float32), [np.zeros((1, dimension), np.float32)])
        index._append(rows, model)
        index.files.write(f"{index.path}/schema.json", T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())]).json())
        index.files.write(f"{index.path}/model.json", model.to_json())
        return index

    def add(self, rows: DataFrame, *, id_col: str = "id", vector_col: str = "vector") -> None:
        """Store further rows under the model there is."""
        self._append(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), self.model())

    def model(self) -> Model:
        return Model.from_json(self.files.read(f"{self.path}/model.json"))

    def _append(self, rows: DataFrame, model: Model) -> None:
        sent = self.spark.sparkContext.broadcast(model)  # of bounded size: cells and entries
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fits, points = units(batch.column(1), sent.value.centres.shape[1])
                cell, code = np.full(len(fits), -1, np.int32), np.full(len(fits), None, object)
                own, codes = sent.value.coded(points)
                cell[fits], code[fits] = own, [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(code.tolist(), pa.binary())], schema=arrow)

        placed = rows.mapInArrow(run, schema)
        # Rebalanced: a cell's rows come together, and a very large cell is split over tasks.
        placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.files.read(f"{self.path}/schema.json")))
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vector: str = "query_vector", probe: int | None = None, shortlist: int = SHORTLIST) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` best of the probed cells for each of at most ``QUERY_BLOCK`` queries."""
        asked = queries.select(query_id, query_vector).limit(QUERY_BLOCK + 1).collect()
        if len(asked) > QUERY_BLOCK:
            raise ValueError(f"more than {QUERY_BLOCK} queries at once")
        model = self.model()
        probe = min(len(model.centres), probe or model.probe)
        fits, unit = units(pa.array([r[1] for r in asked], pa.list_(pa.float32())), model.centres.shape[1])
        known = [r for r, ok in zip(asked, fits) if ok]
        stored = self.rows()
        ranks = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField("id", stored.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        if not known:
            return self.spark.createDataFrame([], ranks)
        at = model.cells_by_nearness(unit)[:, :probe]
        wanted = stored.filter(F.col("cell").isin(np.unique(at).tolist()))
        found = self._best(wanted, unit, at, model, k, shortlist)
        names = T.StructType([T.StructField("n", T.IntegerType()), queries.schema[query_id]])
        names = self.spark.createDataFrame([(n, r[0]) for n, r in enumerate(known)], names)
        order = F.row_number().over(Window.partitionBy("n").orderBy(F.desc(F.round("score", 9)), "id"))
        top = found.withColumn("rank", order).filter(F.col("rank") <= k)
        return top.join(F.broadcast(names), "n").select(*[F.col(f.name) for f in ranks])  # QUERY_BLOCK rows at most

    def _best(self, wanted: DataFrame, unit: np.ndarray, at: np.ndarray, model: Model, k: int, shortlist: int) -> DataFrame:
        """(n, id, score): of each task the ``k`` best rows for each query."""
        by_cell = {int(c): np.flatnonzero((at == c).any(axis=1)) for c in np.unique(at)}
        sent = self.spark.sparkContext.broadcast((unit, unit @ model.centres.T, model.tables(unit), by_cell))  # bounded by QUERY_BLOCK
        schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("id", wanted.schema["id"].dataType), T.StructField("score", T.DoubleType())])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, base, tables, by_cell = sent.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                cells, ids = np.asarray(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cells), tables.shape[1])
                _, vectors = units(batch.column(3), unit.shape[1])
                for c in np.unique(cells).tolist():
                    own, mine = np.flatnonzero(cells == c), by_cell.get(c, ())
                    if not len(mine):
                        continue
                    near = base[mine, c][:, None] + sum(tables[mine, p][:, codes[own, p]] for p in range(tables.shape[1]))
                    few = min(len(own), k * shortlist)
                    edge = -np.partition(-near, few - 1, axis=1)[:, few - 1]
                    for n, row, least in zip(mine.tolist(), near, edge):
                        some = own[row >= least]
                        score, names = vectors[some].astype(np.float64) @ unit[n].astype(np.float64), ids[some]
                        if n in best:
                            score, names = np.concatenate([best[n][0], score]), np.concatenate([best[n][1], names])
                        top = best_of(np.round(score, 9), names, k)
                        best[n] = score[top], names[top]
            for n, (score, names) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), n, np.int32)), pa.array(names.tolist(), arrow.field("id").type), pa.array(score)], schema=arrow)

        return wanted.select(F.col("cell").cast("int").alias("cell"), "id", "code", "vector").mapInArrow(run, schema)


def recall(found: DataFrame, exact: DataFrame, *, query_id: str = "query_id", id_col: str = "id") -> DataFrame:
    """One row: how many exact results there are, and how many of them were found."""
    hit = found.select(query_id, id_col).distinct().withColumn("__hit", F.lit(1))
    return exact.select(query_id, id_col).join(hit, [query_id, id_col], "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("__hit"), F.lit(0)).alias("found"))


def in_blocks(index: VectorIndex, queries: DataFrame, k: int, blocks: int, **options) -> DataFrame:
    """``search`` for any number of queries, cut into ``blocks`` by their ids."""
    key = F.pmod(F.xxhash64(options.get("query_id", "query_id")), F.lit(blocks))
    parts: Sequence[DataFrame] = [index.search(queries.filter(key == b), k, **options) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: A stored collection is searched without its vector index once more of the indexed rows than these are gone.
MOST_LOST = 1000


def index_collection(store: Store, name: str, **options) -> VectorIndex:
    """A vector index over all rows of a stored collection, kept with it; rows that come later are searched exactly beside it."""
    at, about = store._current(name)
    folder = f"vectors-{uuid.uuid4().hex}"
    index = VectorIndex.build(store.read(name), f"{store._at(name)}/{folder}", **options)
    store.set_vectors(name, at, folder, list(about["parts"]))
    return index


def dense_stored(store: Store, name: str, query: Sequence[float], k: int, *, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """``dense_topk`` over a stored collection, by its vector index where it has one.

    What the index finds is read by id from the parts that it covers, so deleted rows
    are left out and scores are exact; other parts are read whole.  With a filter,
    which has to come before the ranking, all rows that pass it are read.
    """
    about = store.describe(name)
    vectors = about.get("vectors")
    covered = [p for p in vectors["parts"] if p in about["parts"]] if vectors else []
    if not covered or where is not None or store.lost(name, covered) > MOST_LOST or len(covered) < len(vectors["parts"]):
        return dense_topk(store.read(name), query, k, where=where, threshold=threshold)
    asked = store.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, query_vector array<double>")
    found = VectorIndex(store.spark, f"{store._at(name)}/{vectors['folder']}").search(asked, k + store.lost(name, covered))
    some = [r["id"] for r in found.select("id").collect()]  # k and MOST_LOST at most
    rows = store.fetch(name, some, covered).unionByName(store.read(name, [p for p in about["parts"] if p not in covered]))
    return dense_topk(rows, query, k, threshold=threshold)
