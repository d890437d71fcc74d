"""Line dedup [native]: winnowing over line hashes.

Every text is a sequence of line hashes.  In each window of ``window`` lines the
smallest hash is selected as a fingerprint, so any run of at least ``window``
lines that two places share is guaranteed to share a fingerprint.  Only selected
positions leave their document, each with the windows that it was selected for;
positions whose fingerprint occurs nowhere else are dropped.  The others are
joined, by those windows, with the first place in the corpus (by doc_id, then by
line) that holds the same.  Each such pair of positions is extended both ways, as
long as the next pair lies at the same distance in the same two documents: these
are the maximal ``matches``.  A document's matches with earlier places merge into
runs, and the runs are deleted.  The first place of every run keeps its lines.

The result is exact: a line goes if and only if a window of ``window``
consecutive lines that covers it has an equal window at an earlier place.
Windows are told apart by 128 bits.

With ``long_lines`` a line that is long by itself (over ``LONG_WORDS`` words, or
over ``LONG_CHARS`` characters, for scripts that set no spaces) is a window of its
own besides, so it also goes if an equal line stands at an earlier place, in texts
of one line too.

Only DataFrame functions are used, all of them linear in a text's lines.
Fingerprints and windows are pre-aggregated before their exchange, and look-ups
join on an image of the key so that a line shared by a third of all documents is
split over many tasks.

Defined results
---------------
* null text: the empty text (one empty line), nothing removed;
* texts of fewer lines than the window: unchanged, but for long lines; windows of
  blank lines only are no repeats;
* ties: the smallest doc_id, then the text's hash, then the earliest line is
  the first place; a null doc_id counts as smallest;
* repeated rows (same doc_id and text): one place, so they don't delete each
  other; each row is returned;
* empty table: no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewick.llm import common

WINDOW = 2
#: A line of more words or more characters than these is long by itself.
LONG_WORDS, LONG_CHARS = 50, 300


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long(line: Column) -> Column:
    words = F.regexp_count(line, F.lit("[^ \\t\\r]+"))  # over LONG_WORDS words take over twice as many characters
    return (F.length(line) > LONG_CHARS) | ((F.length(line) > 2 * LONG_WORDS) & (words > LONG_WORDS))


def fingerprints(docs: DataFrame, window: int = WINDOW, long_lines: bool = False) -> DataFrame:
    """One row per selected position: doc, row, line, its hash (``print``) and the windows it was selected for (at, width and 128 bits)."""
    base = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), _lines(F.col("text")).alias("lines"))
    base = base.select(
        "doc",
        "row",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("b"),
        F.transform("lines", lambda x: F.trim(x) != "").alias("says"),
        *([F.transform("lines", lambda x: _long(x)).alias("long")] if long_lines else []),
    )
    if not long_lines:
        base = base.filter(F.size("a") >= window)

    def entry(i: Column, width: int) -> list[Column]:
        bits = [F.xxhash64(*[F.get(half, i + k) for k in range(width)]).alias(name) for half, name in (("a", "high"), ("b", "low"))]
        return [i.alias("at"), F.lit(width).alias("width"), *bits]

    def selected(i: Column) -> Column:
        """The line with the smallest hash of the window that begins here, the last of equal ones."""
        least = F.array_min(F.array(*[F.struct(F.get("a", i + k).alias("hash"), F.lit(-k).alias("back")) for k in range(window)]))
        says = F.array_max(F.array(*[F.get("says", i + k) for k in range(window)]))
        return F.when(says, i - least["back"]).otherwise(-1)  # blank lines only: none

    # One entry for each window; a text of fewer lines has none.
    starts = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: i <= F.size("a") - window)
    base = base.withColumn("windows", F.transform(starts, lambda i: F.struct(*entry(i, window), selected(i).alias("line"))))

    def chosen(i: Column) -> Column:
        """The windows, all of them near this line, that selected it."""
        near = F.filter(F.slice("windows", F.greatest(i - (window - 2), F.lit(1)), window), lambda w: w["line"] == i)
        mine = F.transform(near, lambda w: F.struct(w["at"].alias("at"), w["width"].alias("width"), w["high"].alias("high"), w["low"].alias("low")))
        if not long_lines:
            return mine
        alone = F.array(F.struct(*entry(i, 1)))
        return F.concat(mine, F.when(F.get("long", i) & F.get("says", i), alone).otherwise(F.filter(alone, lambda w: F.lit(False))))

    places = F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.struct(i.alias("line"), F.get("a", i).alias("print"), chosen(i).alias("windows")))
    # A generator never takes the projection below it in, so the windows are computed once a text and not once a line.
    return base.select("doc", "row", F.inline(F.filter(places, lambda p: F.size(p["windows"]) > 0)))


def _with_runs(df: DataFrame, windows: str, *keys: str) -> DataFrame:
    """The keys and ``runs``: sorted (first, last) of the lines that any of the windows (at, width) covers."""
    covered = F.flatten(F.transform(windows, lambda w: F.sequence(w["at"], w["at"] + w["width"] - 1)))
    lines = df.select(*keys, F.array_sort(F.array_distinct(covered)).alias("__at"))
    n = F.size("__at")
    # A run begins after a gap, and ends before one.
    begins = F.filter("__at", lambda x, i: (i == 0) | (x - F.get("__at", i - 1) > 1))
    ends = F.filter("__at", lambda x, i: (i == n - 1) | (F.get("__at", i + 1) - x > 1))
    return lines.select(*keys, F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("first"), e.alias("last"))).alias("runs"))


def matches(docs: DataFrame, window: int = WINDOW, long_lines: bool = False) -> DataFrame:
    """The maximal matches with first places: doc, row, first and last line there, and the document, row and line where it stands first."""
    found = common.written(fingerprints(docs, window, long_lines), "fingerprints")
    # A fingerprint at one place only is part of no repeat.
    spot = F.struct("doc", "row", "line")
    often = found.groupBy("print").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    often = often.filter(~F.col("lo").eqNullSafe(F.col("hi"))).select(common.image(F.col("print"), "long").alias("key"))
    shared = found.withColumn("key", common.image(F.col("print"), "long")).join(often, "key", "left_semi").select("doc", "row", F.inline("windows"))
    shared = common.written(shared, "positions")
    place = F.struct("doc", "row", "at")
    first = shared.groupBy("high", "low").agg(F.min(place).alias("origin"), F.max(place).alias("final"))
    first = first.filter(~F.col("origin").eqNullSafe(F.col("final"))).select(
        common.image(F.col("high"), "long").alias("h"), common.image(F.col("low"), "long").alias("l"), "origin"
    )
    pairs = (
        shared.withColumn("h", common.image(F.col("high"), "long"))
        .withColumn("l", common.image(F.col("low"), "long"))
        .join(first, ["h", "l"])
        .filter(~place.eqNullSafe(F.col("origin")))
        .select("doc", "row", "at", "width", F.col("origin.doc").alias("origin_doc"), F.col("origin.row").alias("origin_row"), (F.col("at") - F.col("origin.at")).alias("shift"))
    )
    # Extension: pairs at one distance in the same two documents that touch or overlap are one match.
    keys = ["doc", "row", "origin_doc", "origin_row", "shift"]
    lines = _with_runs(pairs.groupBy(*keys).agg(F.collect_set(F.struct("at", "width")).alias("w")), "w", *keys)
    return lines.select("doc", "row", "origin_doc", "origin_row", F.inline("runs"), "shift").select(
        "doc", "row", "first", "last", "origin_doc", "origin_row", (F.col("first") - F.col("shift")).alias("origin_first")
    )


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_lines: bool = False) -> DataFrame:
    """(doc, row, runs): the runs to delete of each document that has any, as sorted (first, last) lines."""
    later = matches(docs, window, long_lines).groupBy("doc", "row").agg(F.collect_list(F.struct(F.col("first").alias("at"), (F.col("last") - F.col("first") + 1).alias("width"))).alias("w"))
    return _with_runs(later, "w", "doc", "row")


def line_dedup(docs: DataFrame, window: int = WINDOW, long_lines: bool = False) -> DataFrame:
    """doc_id, n_lines, runs (what was removed) and the remaining text, one row per input row."""
    runs = repeated_runs(docs, window, long_lines)
    own = docs.select("doc_id", F.col("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    both = own.join(runs, F.col("doc_id").eqNullSafe(F.col("doc")) & (own["row"] == runs["row"]), "left").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), _lines(F.col("text")).alias("lines"), F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)).alias("runs")
    )
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("runs")),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["last"] + 1).alias("a"),
            F.when(i == F.size("runs"), F.size("lines")).otherwise(F.get("runs", i)["first"]).alias("b"),
        ),
    )
    left = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["a"] + 1, g["b"] - g["a"])))
    return both.select(
        "doc_id",
        F.size("lines").cast(T.LongType()).alias("n_lines"),
        "runs",
        F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
    )


def line_dedup_digest(docs: DataFrame, window: int = WINDOW, long_lines: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (``first-last`` joined by ``;``) and the remaining text's SHA-256."""
    done = line_dedup(docs, window, long_lines)
    spans = F.transform("runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string")))
    return done.select(
        "doc_id",
        "n_lines",
        F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r["last"] - r["first"] + 1).alias("n_removed"),
        F.array_join(spans, ";").alias("removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )


ORACLE_SQL = """
WITH line AS (
  SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS pos, unnest(parts) AS line, len(parts) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
win AS (
  SELECT doc_id, pos, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM line),
ranked AS (
  SELECT doc_id, pos,
         (trim(line, ' ') <> '' OR trim(following, ' ') <> '')
         AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) > 1 AS repeat_here
  FROM win WHERE following IS NOT NULL),
alone AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS repeat_line
  FROM line WHERE trim(line, ' ') <> '' AND (length(line) > 300 OR len(regexp_extract_all(line, '[^ \\t\\r]+')) > 50)),
hit AS (
  SELECT l.doc_id, l.pos, l.line, l.n,
         coalesce(r.repeat_here, false) OR coalesce(lag(r.repeat_here) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false)
         OR coalesce(s.repeat_line, false) AS gone
  FROM line l LEFT JOIN ranked r USING (doc_id, pos) LEFT JOIN alone s USING (doc_id, pos)),
run AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b
  FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM hit WHERE gone) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(a || '-' || b, ';' ORDER BY a) AS removed FROM run GROUP BY doc_id)
SELECT h.doc_id, max(h.n) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(max(s.removed), '') AS removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM hit h LEFT JOIN spans s USING (doc_id) GROUP BY h.doc_id
"""
