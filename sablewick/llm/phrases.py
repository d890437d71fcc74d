"""Phrase collocations, by hashed counting (PCY/DHP) with Apriori pruning.

Pass k counts phrases of k words exactly, and in the same reading of the texts
adds phrases of k + 1 words to hash buckets.  Before pass k + 1 counts a phrase,
three fixed-size bitmaps that every task is sent have to allow it: its bucket
reached the support, and so did its first and its last k words (a bitmap of the
hashes of the frequent phrases of k words, which lets all of them through).  Only
phrases that pass k did not rule out are added to buckets at all.  Bitmaps only
ever spare work; what is counted is counted exactly, by words, in Spark.

Bucket counts are kept in each task, cut off at the support, sent as segments of
bytes and added up segment by segment, so no more than one segment is held; the
driver gets the bitmaps only, ``buckets`` bits whatever the input.  A text is read
in blocks that end between pieces.

A phrase's score for a cut after its first k words is
floor(scale * a / (l + r)), with a, l and r the occurrences of the phrase and of
its two sides; the lowest counts.  Integers that may pass 64 bits are decimals.

Defined results
---------------
* null text: empty; null lang: ``und``, together with rows that say ``und``;
* words: runs without blank or tab, between piece ends (``PIECE_END``), A-Z
  lower-cased; overlapping occurrences all count;
* very long texts: whole; a piece (text between two piece ends) is held whole;
* ties of a score's cuts: the earliest; of phrases: by a, then by UTF-8 bytes;
* repeated rows: each row's occurrences count; empty table: no rows;
* extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from sablewick.llm import common

SUPPORT, LONGEST, TOP, SCALE = 30, 4, 2000, 2_000_000
#: A phrase goes if a longer one around it has this share of its occurrences.
SUBSUMED = (80, 100)
BUCKETS, SEGMENTS = 1 << 22, 256
BLOCK_BYTES = 4 << 20

PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: ends a piece
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

COUNTED = "lang string, phrase string, n long, segment int, counters binary"
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def blocks(langs: list[str | None], texts: list[bytes], size: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """Texts in groups of about ``size`` bytes; a longer text is cut after piece ends."""
    own: tuple[list[str], list[bytes]] = ([], [])
    held = 0
    for lang, text in zip(langs, texts):
        at = 0
        while at < len(text):
            end = PIECE_END.search(text, at + size) if len(text) - at > size else None
            stop = end.end() if end else len(text)
            own[0].append("und" if lang is None else lang)
            own[1].append(text[at:stop])
            held, at = held + stop - at, stop
            if held >= size:
                yield own
                own, held = ([], []), 0
    if own[0]:
        yield own


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * MIX[1]
    return hashes ^ (hashes >> np.uint64(29))


@dataclass
class Grams:
    """The words of a block, and which phrases begin at each."""

    words: pa.Array  # distinct words
    word: np.ndarray  # number of each word
    langs: list[str]
    lang: np.ndarray  # number of each word's language
    piece: np.ndarray
    hashes: list[np.ndarray]  # of the phrases of 1, 2, ... words from each word on

    @classmethod
    def of(cls, langs: list[str], texts: list[bytes], longest: int) -> Grams:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kind = KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        letters = LOWER[data[inside]]
        offsets = np.r_[0, np.cumsum(stop - start)]
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        names = sorted(set(langs))
        number = {n: k for k, n in enumerate(names)}
        text_lang = np.array([number[n] for n in langs], np.int64)
        lang = text_lang[np.searchsorted(begins, start, "right") - 1]
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        word = np.asarray(column.indices).astype(np.int64)
        each = np.array([xxhash.xxh64_intdigest(w) for w in column.dictionary.to_pylist()], np.uint64)[word]
        seed = np.array([xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass")) for n in names], np.uint64)
        hashes = [mixed(seed[lang] + each * MIX[0])] if len(word) else [np.zeros(0, np.uint64)]
        for k in range(1, longest):
            hashes.append(mixed(hashes[-1][:-1] * MIX[0] + each[k:]) if len(hashes[-1]) else hashes[-1])
        return cls(column.dictionary.cast(pa.large_string()), word, names, lang, piece, hashes)

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one piece."""
        n = max(0, len(self.word) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :]

    def counts(self, k: int, at: np.ndarray) -> tuple[list, list, list]:
        """Languages, phrases and occurrences of the distinct phrases of k words that begin at these places."""
        if not len(at):
            return [], [], []
        number = self.lang[at]
        for j in range(k):
            pair = number * len(self.words) + self.word[at + j]
            values, first, number = np.unique(pair, return_index=True, return_inverse=True)
        one = at[first]
        phrases = pc.binary_join_element_wise(*[self.words.take(pa.array(self.word[one + j])) for j in range(k)], pa.scalar(" ", pa.large_string()))
        return [self.langs[x] for x in self.lang[one]], phrases.to_pylist(), np.bincount(number, minlength=len(values)).tolist()


def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0


def count_pass(docs: DataFrame, k: int, reached: Broadcast | None, frequent: Broadcast | None, support: int, longest: int, buckets: int, segments: int, block: int) -> DataFrame:
    """Rows of ``COUNTED``: occurrences of phrases of k words, and segments of bucket counts of those of k + 1."""
    schema = _parse_datatype_string(COUNTED)
    arrow = to_arrow_schema(schema)
    kind = np.uint8 if support < 256 else np.int64
    common.bound_batches(docs.sparkSession)

    def allowed(grams: Grams) -> np.ndarray:
        """Whether a phrase of k words begins at each word that isn't ruled out."""
        ok = grams.within(k)
        if reached is not None and len(ok):
            shorter = has(frequent.value, bucket(grams.hashes[k - 2], buckets))
            ok = ok & shorter[: len(ok)] & shorter[1 : len(ok) + 1] & has(reached.value, bucket(grams.hashes[k - 1], buckets))
        return ok

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets if k < longest else 0, np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for langs, own in blocks(batch.column(0).to_pylist(), texts, block):
                grams = Grams.of(langs, own, min(longest, k + 1))
                ok = allowed(grams)
                lang, phrase, n = grams.counts(k, np.flatnonzero(ok))
                yield rows(lang=lang, phrase=phrase, n=n)
                if k < longest and len(ok) > 1:
                    further = grams.within(k + 1) & ok[:-1] & ok[1:]
                    held += np.bincount(bucket(grams.hashes[k][further], buckets), minlength=buckets)
        parts = np.minimum(held, support).astype(kind).reshape(segments, -1) if k < longest else held
        for s in range(segments if k < longest else 0):
            if parts[s].any():
                yield rows(segment=[s], counters=[parts[s].tobytes()])

    return docs.select("lang", "text").mapInArrow(run, schema)


def bitmap(parts: DataFrame, support: int, buckets: int, segments: int) -> np.ndarray:
    """The buckets (as bits) whose counters, over all rows (segment, counters), add up to the support."""
    kind = np.uint8 if support < 256 else np.int64
    size = buckets // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, np.zeros(size, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"segment": pa.array([own], pa.int32()), "bits": pa.array([np.packbits(total >= support).tobytes()], pa.binary())})

        for batch in batches:
            for segment, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own not in (None, segment):
                    yield done()
                    total[:] = 0
                own = segment
                total += np.frombuffer(counters, kind)
        if own is not None:
            yield done()

    dealt = parts.select("segment", "counters").repartition("segment").sortWithinPartitions("segment")
    bits = np.zeros((segments, size // 8), np.uint8)
    for segment, own in dealt.mapInArrow(run, "segment int, bits binary").collect():  # one row for each segment
        bits[segment] = np.frombuffer(own, np.uint8)
    return bits.ravel()


def marked(phrases: DataFrame, k: int, support: int, buckets: int, segments: int) -> np.ndarray:
    """A bitmap of the hashes of these phrases (lang, phrase) of k words."""
    kind = np.uint8 if support < 256 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, bool)
        for batch in batches:
            if batch.num_rows:
                grams = Grams.of(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), k)
                held[bucket(grams.hashes[-1][::k], buckets)] = True  # every k-th word begins a phrase
        for s, part in enumerate(held.reshape(segments, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "counters": pa.array([(part * support).astype(kind).tobytes()], pa.binary())})

    return bitmap(phrases.select("lang", "phrase").mapInArrow(run, "segment int, counters binary"), support, buckets, segments)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, buckets: int = BUCKETS, segments: int = SEGMENTS, block: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words with f >= ``support``, and (lang, n), the words of each language."""
    spark, found, reached, before = docs.sparkSession, [], None, None
    for k in range(1, longest + 1):
        counted = common.written(count_pass(docs, k, reached, before, support, longest, buckets, segments, block), f"counted-{k}")
        exact = counted.filter("segment IS NULL")
        if k == 1:
            totals = common.written(exact.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        own = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
        found.append(common.written(own.select("lang", "phrase", F.lit(k).alias("words"), "f"), f"frequent-{k}"))
        if k < longest:
            reached = spark.sparkContext.broadcast(bitmap(counted.filter("segment IS NOT NULL"), support, buckets, segments))  # of fixed size
            before = spark.sparkContext.broadcast(marked(found[-1], k, support, buckets, segments))  # of fixed size
    every = found[0]
    for own in found[1:]:
        every = every.unionByName(own)
    return every, totals


def scored(frequent: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words or more, by their lowest-scoring cut."""
    cuts = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', cut)"), "tail": F.expr("substring_index(phrase, ' ', cut - words)")})
    # Joined on images of the keys, so that a word in which very many phrases begin or end can be split.
    side = frequent.select(F.col("lang").alias("of"), common.image(F.col("phrase")).alias("side"), "f")
    both = cuts.join(side.select("of", "side", F.col("f").alias("l")), (F.col("lang") == F.col("of")) & (common.image(F.col("head")) == F.col("side"))).drop("of", "side")
    both = both.join(side.select("of", "side", F.col("f").alias("r")), (F.col("lang") == F.col("of")) & (common.image(F.col("tail")) == F.col("side"))).drop("of", "side")
    # ``div`` of decimals is exact; a quotient of decimals would be rounded first.
    score = F.expr(f"CAST({scale} AS DECIMAL(12, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    least = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "words", "a", "l", "r")).alias("best"))
    return least.select("lang", "phrase", *[F.col(f"best.{c}") for c in ("words", "a", "l", "r", "score")])


def outlying(rows: DataFrame, subsumed: tuple[int, int] = SUBSUMED) -> DataFrame:
    """The phrases that no longer phrase around them nearly always replaces."""
    share, whole = subsumed
    longer = rows.filter("words > 2").select("lang", F.split("phrase", " ").alias("w"), "words", "a")
    longer = longer.select("lang", "w", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("lang", "w", "size", "a", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    most = longer.groupBy(F.col("lang").alias("of"), F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("inner")).agg(F.max("a").alias("most"))
    kept = f"most IS NULL OR CAST({whole} AS DECIMAL(9, 0)) * CAST(most AS DECIMAL(19, 0)) < CAST({share} AS DECIMAL(9, 0)) * CAST(a AS DECIMAL(19, 0))"
    return rows.join(most, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")), "left").filter(kept).drop("of", "inner", "most")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, scale: int = SCALE, subsumed: tuple[int, int] = SUBSUMED, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    frequent, totals = frequent_phrases(docs, support, longest, **sizes)
    rows = common.written(outlying(scored(frequent, scale), subsumed), "phrases")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The best of each share of a language first, so that no task ranks a whole language.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {LONGEST + 1}) t(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT c.*, x.f AS l, y.f AS r, {SCALE}::HUGEINT * a // (x.f + y.f) AS score, h
  FROM (SELECT *, unnest(range(1, k)) AS h FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:h], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[h + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1),
inner_phrase AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_phrase i USING (lang, phrase) WHERE i.most IS NULL OR {SUBSUMED[1]}::HUGEINT * i.most < {SUBSUMED[0]}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= {TOP}
"""
