"""Vector code compression: product codes with integer codebooks.

Each component x becomes the integer floor(``scale`` * x), and each vector is cut
into ``parts`` equal consecutive parts.  The codebook of a part position begins as
that part of the ``entries`` kept vectors with the smallest ids.  A round sends a
kd-tree for each codebook to every task, which assigns its parts to their nearest
entries and adds them up; what tasks return are integer sums, one row for each
entry that was used, and Spark adds those.  An entry then becomes the floor of
sum / count, and an unused one stays.

The nearest-entry search is a branch and bound over the tree's boxes, for a whole
batch of parts at once: each part is first measured in the leaf that it falls
into, then every box is visited by the parts that may find an entry as near or
nearer there.  Boxes with an equal bound are visited too, so that of equally near
entries the one with the lowest index is found.  All arithmetic is in 64-bit
integers; components of a size for which that would not be exact raise an error.

What a task holds besides its batch is the trees and one sum for each entry, both
of a size that the data don't change; the driver sees the same.  The table is read
once for the first codebooks, once in each round and once for the codes.

Defined results
---------------
* vectors that are null or hold a null or non-finite component: dropped, without
  any influence; empty table, or none kept: no rows, and empty codebooks;
* vectors of another length than the kept one with the smallest id: they can't be
  coded, so they have no part in codebooks, and their code and error are null;
* ties: first codebooks take vectors by id (null last), then by their components;
  equally near entries go to the lower index;
* fewer vectors than ``entries``: smaller codebooks;
* repeated rows: each is a row and counts in sums; null labels are one group;
* extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sablewick.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 16
#: Label sums up to this many rows are sent to every task; more are joined by a shuffle.
FEW_LABELS = 10_000


@dataclass
class Node:
    low: np.ndarray  # the box of the entries below
    high: np.ndarray
    members: np.ndarray | None = None  # of a leaf, ascending
    axis: int = 0
    at: int = 0  # entries on the right have this much or more on the axis
    left: int = -1
    right: int = -1


class KdTree:
    """The entries of one codebook; finds the nearest, of equally near ones that with the lowest index."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.nodes = entries, []
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        own = self.entries[members]
        node = Node(own.min(axis=0), own.max(axis=0))
        number = len(self.nodes)
        self.nodes.append(node)
        spread = node.high - node.low
        if len(members) <= LEAF or not spread.any():
            node.members = members
            return number
        node.axis = int(spread.argmax())
        along = own[:, node.axis]
        node.at = int(np.sort(along)[len(along) // 2])
        if node.at == node.low[node.axis]:  # more than half lie on the lower face
            node.at = int(along[along > node.at].min())
        right = along >= node.at
        node.left, node.right = self._grow(members[~right]), self._grow(members[right])
        return number

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each point."""
        # Doubles hold integers exactly up to 2^53, and their products are much faster.
        most = max(int(np.abs(x).max(initial=0)) for x in (points, self.entries))
        kind = np.float64 if points.shape[1] * (2 * most) ** 2 < 1 << 53 else np.int64
        points, entries = points.astype(kind), self.entries.astype(kind)
        own_square, square = (points * points).sum(axis=1), (entries * entries).sum(axis=1)
        best = np.full(len(points), len(entries))
        least = np.full(len(points), np.iinfo(np.int64).max).astype(kind)
        home = np.full(len(points), -1)

        def measure(number: int, rows: np.ndarray) -> None:
            members = self.nodes[number].members
            far = own_square[rows, None] - 2 * (points[rows] @ entries[members].T) + square[members]
            first = far.argmin(axis=1)
            far, index = far[np.arange(len(rows)), first], members[first]
            nearer = (far < least[rows]) | (far == least[rows]) & (index < best[rows])
            best[rows[nearer]], least[rows[nearer]] = index[nearer], far[nearer]

        def descend(number: int, rows: np.ndarray) -> None:
            node = self.nodes[number]
            if node.members is not None:
                home[rows] = number
                measure(number, rows)
                return
            right = points[rows, node.axis] >= node.at
            for child, own in ((node.left, rows[~right]), (node.right, rows[right])):
                if len(own):
                    descend(child, own)

        def visit(number: int, rows: np.ndarray) -> None:
            node, own = self.nodes[number], points[rows]
            outside = np.maximum(node.low - own, 0) + np.maximum(own - node.high, 0)
            rows = rows[np.einsum("ij,ij->i", outside, outside) <= least[rows]]
            if node.members is not None:
                rows = rows[home[rows] != number]
                if len(rows):
                    measure(number, rows)
            elif len(rows):
                visit(node.left, rows)
                visit(node.right, rows)

        if len(points):
            every = np.arange(len(points))
            descend(0, every)
            visit(0, every)
        return best, least.astype(np.int64)


@dataclass
class Codebooks:
    """One array of entries (rows) for each part position; empty where nothing was kept."""

    books: list[np.ndarray]
    dimension: int
    scale: int = SCALE
    trees: list[KdTree] = field(default_factory=list)

    def __post_init__(self):
        self.trees = [KdTree(b) for b in self.books]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()

    def assign(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part, and summed squared distance, of integer vectors (rows)."""
        width = self.dimension // len(self.books)
        found = [tree.nearest(np.ascontiguousarray(numbers[:, k * width : (k + 1) * width])) for k, tree in enumerate(self.trees)]
        return np.stack([index for index, _ in found], axis=1), sum(far for _, far in found)

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        digits = max(2, len(f"{max(len(b) for b in self.books) - 1:x}"))
        return [x / self.scale for k, book in enumerate(self.books) for x in book[int(code[k * digits : (k + 1) * digits], 16)].tolist()]


def kept(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), where squared distances of such vectors fit into 64 bits."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    most = np.sqrt(2.0**61 / max(1, vectors.shape[1])) / 2
    if scaled.size and np.abs(scaled).max() > most:
        raise ValueError(f"components beyond {most / scale:.3g} can't be coded exactly")
    return scaled.astype(np.int64)


def stacked(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have vectors of this length, and those as one array."""
    lists = column.cast(pa.list_(pa.float64()))
    fits = np.diff(np.asarray(lists.offsets)) == length
    return fits, np.asarray(lists.filter(pa.array(fits)).flatten()).reshape(-1, length) if length else np.zeros((fits.sum(), 0))


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int, id_col: str, vector_col: str) -> Codebooks:
    """Codebooks from the vectors with the smallest ids."""
    rows = vectors.filter(kept(F.col(vector_col))).select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    order = (F.col("i").asc_nulls_last(), F.col("v"))
    top = rows.orderBy(*order).limit(1).collect()
    if not top:
        return Codebooks([], 0, scale)
    length = len(top[0]["v"])
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("v") == length).orderBy(*order).limit(entries).collect()
    numbers = integers(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), length), scale)
    return Codebooks(np.split(numbers, parts, axis=1), length, scale)


def moved(vectors: DataFrame, books: Codebooks, vector_col: str) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the middle of its parts."""
    width = books.dimension // len(books.books)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # of fixed size: entries, not rows
    common.bound_batches(vectors.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        totals = [np.zeros_like(b) for b in own.books]
        counts = [np.zeros(len(b), np.int64) for b in own.books]
        for batch in batches:
            numbers = integers(stacked(batch.column(0), own.dimension)[1], own.scale)
            index, _ = own.assign(numbers)
            for k, (total, count) in enumerate(zip(totals, counts)):
                np.add.at(total, index[:, k], numbers[:, k * width : (k + 1) * width])
                count += np.bincount(index[:, k], minlength=len(count))
        used = [(k, int(e)) for k, count in enumerate(counts) for e in np.flatnonzero(count)]
        rows = {"part": [k for k, _ in used], "entry": [e for _, e in used], "n": [int(counts[k][e]) for k, e in used], "total": [totals[k][e].tolist() for k, e in used]}
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)

    sums = vectors.filter(kept(F.col(vector_col))).select(vector_col).mapInArrow(add, schema)
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    new = [b.copy() for b in books.books]
    for part, entry, n, *total in sums.collect():  # one row for each entry
        new[part][entry] = [t // n for t in total]
    return Codebooks(new, books.dimension, books.scale)


def learn_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, *, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks after ``rounds`` rounds over all kept vectors."""
    books = first_books(vectors, parts, entries, scale, id_col, vector_col)
    for _ in range(rounds if books.books else 0):
        books = moved(vectors, books, vector_col)
    return books


def encode(vectors: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code (hex digits of each part's entry) and error (squared distance) of every kept vector."""
    rows = vectors.filter(kept(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.books:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).limit(0)
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # of fixed size
    digits = max(2, len(f"{max(len(b) for b in books.books) - 1:x}"))

    def work(batch: pa.RecordBatch) -> dict:
        fits, values = stacked(batch.column(2), sent.value.dimension)
        index, far = sent.value.assign(integers(values, sent.value.scale))
        hexes = np.array([f"{i:0{digits}x}" for i in range(int(index.max()) + 1 if len(index) else 0)])
        code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
        code[fits], error[fits] = ["".join(row) for row in hexes[index]] if len(index) else [], far
        return {"vec_id": batch.column(0), "label": batch.column(1), "code": code.tolist(), "error": error.tolist()}

    return common.map_batches(rows, schema, work)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", few_labels: int = FEW_LABELS) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels) and the codebooks' digest."""
    books = learn_codebooks(vectors, parts, entries, rounds, scale, id_col=id_col, vector_col=vector_col)
    rows = common.written(encode(vectors, books, id_col=id_col, vector_col=vector_col, label_col=label_col), "codes")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    sums = common.written(rows.groupBy(key.alias("k")).agg(F.sum("error").alias("label_error")), "label-errors")
    # A label may hold any share of the rows: its sum is sent along while labels are few, else adaptive execution can split the join.
    sums = F.broadcast(sums) if sums.limit(few_labels + 1).count() <= few_labels else sums.hint("merge")
    joined = rows.withColumn("k", key).join(sums, "k", "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    steps, book = [], "b0"
    for k in range(1, ROUNDS + 2):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT n, p, (best % {ENTRIES})::BIGINT AS e, (best // {ENTRIES})::BIGINT AS far
  FROM (SELECT n, p, min((list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y))::HUGEINT * {ENTRIES} + e) AS best
        FROM part JOIN {book} USING (p) GROUP BY n, p))""")
        if k <= ROUNDS:
            steps.append(f"""
m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS y
  FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS m
        FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM part JOIN a{k} USING (n, p)) GROUP BY p, e, i)
  GROUP BY p, e),
b{k} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM {book} b LEFT JOIN m{k} m USING (p, e))""")
            book = f"b{k}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT n, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS y FROM part WHERE n <= {ENTRIES}),{",".join(steps)},
code AS (SELECT n, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS + 1} GROUP BY n),
digest AS (
  SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(y) AS c, generate_subscripts(y, 1) AS i FROM {book}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN code USING (n), digest
"""


ORACLE_SQL = _sql()
