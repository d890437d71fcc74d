"""Packing by best-fit decreasing, with a segment tree over remaining capacity.

Each document's ids (by the tokenizers library, then an end id) are cut into
full windows first; the rest, shorter than a window, is one more piece.  Pieces
are written with a row number and dealt by a hash of it into shards of about
``SHARD_PIECES``, so rows that are repeated don't meet in one shard either; a full
window is a sequence of its own.  In each shard pieces go in descending
length into the tightest open window that still holds them, which a segment
tree indexed by remaining capacity finds in log2(window) steps.

Shards are of bounded size and their number follows the input, so no task holds
more than a bounded list of (doc_id, length).  A shard's own padding is that of
its last windows, well under one percent.

Defined results
---------------
* null text: empty, so just the end id; empty table: no rows;
* very long texts: whole; tokenised in bounded parts;
* ties in length: by doc_id, then by the piece's checksum; which shard a piece is
  dealt to follows the order in which pieces are stored;
* repeated rows (same doc_id): packed once for each row, in any number of shards;
* null doc_id: packed like any other; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sablewick.llm import common
from sablewick.llm.pretokens import pretokenizer, printable

WINDOW, END_ID, SHARD_PIECES = 4096, 2, 2048
#: Pre-tokens whose ids are kept, and the longest that is.
KEPT, KEPT_CHARS = 250_000, 64


class BestFit:
    """Open windows, found by remaining capacity.

    A segment tree over the capacities 0..window: each leaf holds a stack of the
    open windows with exactly that much room, each inner node whether any leaf
    below it holds one.  ``fit`` descends to the smallest capacity that is large
    enough.
    """

    def __init__(self, window: int):
        self.window = window
        self.size = 1 << window.bit_length()
        self.filled = bytearray(2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _set(self, room: int, to: int) -> None:
        node = room + self.size
        self.filled[node] = to
        while node := node >> 1:
            new = self.filled[2 * node] | self.filled[2 * node + 1]
            if self.filled[node] == new:
                break
            self.filled[node] = new

    def open(self, window: int, room: int) -> None:
        self.stacks[room].append(window)
        if len(self.stacks[room]) == 1:
            self._set(room, 1)

    def fit(self, length: int) -> tuple[int, int] | None:
        """Take out the tightest open window with room for ``length``: (window, room)."""
        node = length + self.size
        if not self.filled[node]:
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            self._set(room, 0)
        return window, room


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) for each piece; ``lengths`` must descend."""
    fits, placed, opened = BestFit(window), [], 0
    for n in lengths:
        found = fits.fit(n)
        if found is None:
            found, opened = (opened, window), opened + 1
        number, room = found
        placed.append((number, window - room))
        if room > n:
            fits.open(number, room - n)
    return placed


class Ids:
    """Ids of texts, by the tokenizers library, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.cutter = pretokenizer(path)
        self.kept: dict[str, bytes] = {}

    def of_batch(self, texts: list[str]) -> list[bytes]:
        cut: list[list] = [list(self.cutter.segments(t)) for t in texts]
        kept = self.kept
        unknown = {p for own in cut for s in own if not isinstance(s, int) for p in s} - kept.keys()
        found = {}
        tokenize = self.cutter.library.model.tokenize
        for piece in unknown:
            ids = [t.id for t in tokenize(printable(piece.encode()))]
            found[piece] = struct.pack(f"<{len(ids)}I", *ids)
        if len(kept) + len(found) > KEPT:
            found |= {p: kept[p] for own in cut for s in own if not isinstance(s, int) for p in s if p in kept}
            kept.clear()
        kept.update(found)
        get = kept.__getitem__
        out = [b"".join([struct.pack("<I", s) if isinstance(s, int) else b"".join(map(get, s)) for s in own]) for own in cut]
        for piece in [p for p in found if len(p) > KEPT_CHARS]:
            kept.pop(piece, None)
        return out


@lru_cache(maxsize=2)
def ids_by(path: str) -> Ids:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Ids(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: full windows first, then the rest."""
    end, step = struct.pack("<I", end_id), 4 * window

    def work(batch: pa.RecordBatch):
        encoder = ids_by(path)
        for part in common.slices(batch, "text"):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.of_batch(common.texts_of(part.column(1)))):
                ids += end
                total = len(ids) // 4
                for k in range(0, len(ids), step):
                    piece = ids[k : k + step]
                    rows.append((doc_id, k // 4, len(piece) // 4, zlib.crc32(piece), total))
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), map(list, zip(*rows))))

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(PIECES), work)


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, start, length, ids_crc32, ...).

    A sequence id is the shard number times 2^32 plus the window's number in
    its shard, so shards need not know of each other.
    """
    rows = common.written(pieces.withColumn("__sw_row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-rows.count() // shard_pieces))
    dealt = rows.withColumn("__sw_shard", F.pmod(F.xxhash64("__sw_row"), F.lit(shards))).drop("__sw_row")
    tasks = max(1, min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(tasks, "__sw_shard").sortWithinPartitions("__sw_shard", F.desc("length"), "doc_id", "start", "ids_crc32")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)

    def finish(shard: int, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        one = pa.concat_tables(held).drop_columns(["__sw_shard"])
        placed = best_fit_decreasing(one["length"].to_pylist(), window)
        one = one.append_column("sequence_id", pa.array([shard << 32 | w for w, _ in placed], pa.int64()))
        one = one.append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        yield from one.cast(arrow).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            numbers = batch.column("__sw_shard").to_pylist()
            at = 0
            while at < len(numbers):
                stop = at
                while stop < len(numbers) and numbers[stop] == numbers[at]:
                    stop += 1
                if shard is not None and numbers[at] != shard:
                    yield from finish(shard, held)
                    held = []
                shard = numbers[at]
                held.append(pa.Table.from_batches([batch.slice(at, stop - at)]))
                at = stop
        if held:
            yield from finish(shard, held)

    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document."""
    return pack(pieces(docs, path, window), window)
