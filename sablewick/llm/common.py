"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table with Spark's own reader, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only on a single machine
    (in tests) may that be unset; then a folder in the warehouse is used.  What is
    written stays until ``clear_scratch``, since results read it lazily.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/sablewick-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything ``written`` has left for this application."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(conf).delete(path, True)


def image(col: Column, kind: str = "string") -> Column:
    """A one-to-one image of a join key that no earlier exchange is partitioned by.

    An aggregate is partitioned by its grouping columns, and a join that uses
    any of those would reuse that partitioning, which keeps adaptive execution
    from splitting a skewed key.  Joining on this image instead exchanges both
    sides, so that a key with a third of all rows is split over many tasks.
    """
    return F.concat(F.lit("="), col) if kind == "string" else F.bitwise_not(col)


#: Rows and bytes of one record batch on its way to Python: the session's default, and ours.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bound_batches(spark: SparkSession) -> None:
    """Keep record batches small where the session leaves them at their defaults, since texts can be long."""
    for key, (default, ours) in BATCH_BOUNDS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def map_batches(df: DataFrame, schema: T.StructType, work: Callable[[pa.RecordBatch], dict | Iterable[dict]]) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to columns (a dict of lists), or several of those."""
    arrow = to_arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            for cols in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, n: int, total: int, hash: Column) -> DataFrame:
    """The ``n`` of ``total`` rows with the smallest hashes; all if there are no more.

    Rows are first cut by a threshold on the hash that lets about 1.5 n of them
    pass, so that what is gathered to be ordered does not grow with the input.
    """
    if total > 2 * n:
        rows = rows.filter(hash < F.lit(-(1 << 63) + int((1 << 64) * 1.5 * n / total)))
    return rows.orderBy(hash).limit(n)


def keep_rows(df: DataFrame, text: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows of ``df``, whole and with their own columns, whose text ``keep`` approves of.

    Rows pass through Python once and nothing is joined back, so columns of any
    name are safe; a null text reaches ``keep`` as None.
    """
    at = df.columns.index(text)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a batch as Python strings, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str | int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``most_bytes``; one row is never cut."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def parts(texts: list[str], chars: int) -> Iterator[list[int]]:
    """Numbers of consecutive texts with at most ``chars`` characters in all; a longer text stands alone."""
    part, held = [], 0
    for i, t in enumerate(texts):
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(t)
    if part:
        yield part


def slices_of(text: str, chars: int, many: int = 8) -> str:
    """A text of at most ``chars`` characters whole; of a longer one, evenly spread slices with so many in all."""
    if len(text) <= chars:
        return text
    size = chars // many
    step = (len(text) - size) / (many - 1)
    return "\n".join(text[int(k * step) : int(k * step) + size] for k in range(many))


BLANK = re.compile(r"\s")


def pieces(text: str, chars: int, longest: int) -> Iterator[str]:
    """A text in consecutive pieces of about ``chars`` characters, cut where no word goes on.

    The cut is at the first blank after a piece's ``chars`` characters; where
    there is none in as many again, after a run of letters' multiple of
    ``longest`` characters, which is where words are cut anyway.
    """
    at, n, chars = 0, len(text), max(chars, longest)
    while n - at > chars:
        m = BLANK.search(text, at + chars, min(n, at + 2 * chars))
        if m:
            to = m.start() + 1
        else:
            to = min(n, at + 2 * chars)
            start = to
            while start > at and text[start - 1].isalnum():
                start -= 1
            to -= (to - start) % longest if to - start > longest else to - start
        yield text[at:to]
        at = to
    if at < n or not n:
        yield text[at:]
