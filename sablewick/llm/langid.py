"""Language ID of mixed-language text.

A text is cut into words (runs of letters).  The script of a word's letters
narrows its candidate languages to those that were learned with that script.
Each word gets a log-likelihood per candidate from its letter trigrams and from
the word itself; Viterbi over the words, with a penalty for every switch, labels
spans of one language.  The text's language is the one with most letters.

Learning counts trigrams and words, as a Spark job, over the whole texts of a
sample that is bounded for each language (``sample_docs`` distinct texts, those
with the smallest hashes), so copies count once and a rare language is learned
like a common one.  At most ``most_languages`` languages are learned, the most
frequent ones, and the hashed tables get fewer buckets where there are many, so
the model has no more than ``MOST_ENTRIES`` numbers.  Scoring runs in numpy over
whole record batches and sees every character of every text.

A text longer than ``PART_CHARS`` is read twice in parts: first each chunk of
words is passed from every state that it may begin in, all chunks side by side,
and the chunks' ends are chained; then each chunk is labelled between its own
first and last state.  That is Viterbi over the whole text, in bounded memory.

Defined results
---------------
* null text, and texts without a letter: ``und``, score 0;
* letters of a script that no learned language has: all languages stay
  candidates with equal scores, so the most frequent one is named, score 0;
* very long texts: whole, in parts of bounded size, labelled as well as if uncut (but
  for a word of over half a million characters, which is cut; of equally good
  labellings it may be another);
* ties between languages: the alphabetically first;
* rows with a null text, lang or doc_id, and of more than ``most_languages`` languages
  the rarest: never learned from; a null doc_id is not
  held out;
* repeated rows: equal texts get equal results; empty table: no rows; with no
  labelled row at all every text is ``und``;
* extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from sablewick.llm import common

UNKNOWN = "und"
#: Learned from: texts of each language, texts in all (which bounds them where there are many languages); languages learned.
SAMPLE_DOCS, SAMPLE_TEXTS, MOST_LANGUAGES = 1000, 10_000, 256
SWITCH_PENALTY = 10.0
#: Buckets of hashed trigrams and words, and how many numbers (buckets times languages) a model has at most.
TRIGRAM_BITS, WORD_BITS, MOST_ENTRIES = 17, 18, 1 << 25
PART_CHARS, CHUNK_WORDS, LONGEST_WORD = 1 << 18, 512, 4096

# First and last code points of scripts, after the Unicode standard.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
SCRIPTS = ("other", *SCRIPT_RANGES)


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point of the basic plane is a letter, and its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    script = np.zeros(0x10000, np.int8)
    for k, ranges in enumerate(SCRIPT_RANGES.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = k
    return letter, script


LETTER, SCRIPT = _code_tables()


@dataclass
class Words:
    """The words of several texts, in order."""

    text: np.ndarray  # number of the text
    letters: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray  # hashes, all words one after another
    first: np.ndarray  # where each word's trigrams begin
    whole: np.ndarray  # hash of the word
    start: np.ndarray  # character offsets in the text
    stop: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Cut lower-cased texts into words and hash them, all in numpy."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, 0xFFFF)
    letter = LETTER[low]
    for i in np.flatnonzero(codes > 0xFFFF):
        letter[i] = chr(int(codes[i])).isalpha()
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(begins, start, "right") - 1
    inside = np.where(letter, codes, 0).astype(np.uint64)
    before, after = np.r_[np.uint64(0), inside[:-1]], np.r_[inside[1:], np.uint64(0)]
    tri = (before * np.uint64(0x9E3779B97F4A7C15) + inside) * np.uint64(0xBF58476D1CE4E5B9) + after
    tri = (tri * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - TRIGRAM_BITS)
    tri = tri[letter].astype(np.int64)
    sizes = stop - start
    first = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
    if len(sizes):
        place = (np.arange(len(tri)) - np.repeat(first, sizes)).astype(np.uint64)
        mixed = (inside[letter] + np.uint64(0x51ED)) * (place * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93)) ** np.uint64(2)
        whole = (np.add.reduceat(mixed, first) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - WORD_BITS)
    else:
        whole = np.zeros(0, np.uint64)
    return Words(owner, sizes, SCRIPT[low[start]], tri, first, whole.astype(np.int64), start - begins[owner], stop - begins[owner])


@dataclass
class Model:
    """Per language: log-probabilities of hashed trigrams and words; which scripts it was learned with."""

    languages: list[str]
    trigram: np.ndarray
    word: np.ndarray
    uses: np.ndarray  # scripts by languages
    order: np.ndarray  # languages by frequency
    penalty: float = SWITCH_PENALTY
    spared: int = 0  # bits of the hashes that the tables leave out

    def scores(self, words: Words) -> np.ndarray:
        """Log-likelihood of each word (rows) in each language, the best at 0; non-candidates far below."""
        if not len(words.first):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.add.reduceat(self.trigram[words.trigrams >> self.spared], words.first, axis=0) + self.word[words.whole >> self.spared]
        known = self.uses.any(axis=1)[words.script]
        out = np.where(known[:, None], out, 0)
        out -= out.max(axis=1, keepdims=True)
        out = np.maximum(out, -25)  # one odd word decides nothing alone
        return np.where(known[:, None] & ~self.uses[words.script], -1e4, out).astype(np.float32)


def spared_bits(languages: int) -> int:
    """By how many bits hashes are cut so that the tables of so many languages stay within ``MOST_ENTRIES``."""
    bits = 0
    while languages * ((1 << TRIGRAM_BITS - bits) + (1 << WORD_BITS - bits)) > MOST_ENTRIES and bits < TRIGRAM_BITS:
        bits += 1
    return bits


@dataclass
class Counts:
    """How often trigrams, words, scripts (rows) and texts were seen in each language (columns)."""

    trigram: np.ndarray
    word: np.ndarray
    script: np.ndarray
    texts: np.ndarray

    @classmethod
    def none(cls, languages: int) -> Counts:
        bits = spared_bits(languages)
        return cls(*(np.zeros((n, languages)) for n in (1 << TRIGRAM_BITS - bits, 1 << WORD_BITS - bits, len(SCRIPTS))), np.zeros(languages))

    def tables(self) -> list[np.ndarray]:
        return [self.trigram, self.word, self.script, self.texts[None]]


def seen(texts: list[str], own: np.ndarray, languages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What texts (short ones, or pieces of longer ones) add to each table of ``Counts``: places in the flat table, and how often."""
    bits = spared_bits(languages)
    w = words_of([t.lower() for t in texts])
    lang = own[w.text]
    at = [(w.trigrams >> bits) * languages + np.repeat(lang, w.letters), (w.whole >> bits) * languages + lang, np.repeat(w.script.astype(np.int64) * languages + lang, w.letters)]
    return [np.unique(x, return_counts=True) for x in at]


def fitted(names: list[str], counts: Counts, penalty: float) -> Model:
    """Log-probabilities from counts, with a little added to each."""
    tri, word = counts.trigram + 0.05, counts.word + 0.02
    uses = counts.script > 0.01 * np.maximum(1, counts.script.sum(axis=0))
    for table, few in ((tri, 0.05), (word, 0.02)):
        never = table.max(axis=1, initial=0) < 1 + few / 2  # buckets never seen say nothing
        np.log(table / table.sum(axis=0), out=table)
        table[never] = 0
    return Model(names, tri.astype(np.float32), word.astype(np.float32), uses, np.argsort(-counts.texts, kind="stable"), penalty, spared_bits(len(names)))


def learn(texts: list[str], languages: list[str], penalty: float = SWITCH_PENALTY) -> Model:
    """Learn from a few texts at hand."""
    names = sorted(set(languages))
    counts, own = Counts.none(len(names)), np.array([names.index(x) for x in languages], np.int64)
    np.add.at(counts.texts, own, 1)
    for i, text in enumerate(texts):
        for piece in common.pieces(text, PART_CHARS, LONGEST_WORD):
            for table, (at, n) in zip(counts.tables(), seen([piece], own[i : i + 1], len(names))):
                table.reshape(-1)[at] += n
    return fitted(names, counts, penalty)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """The best labels for sequences of words that lie one after another.

    All sequences advance together, the longest first, so each step works on one
    array over the sequences that still have a word.  ``begins`` gives the state
    before each sequence, ``ends`` that of its last word, where these are known.
    """
    total, states = scores.shape
    labels = np.zeros(total, np.int32)
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # sequences longer than t
    switched = np.zeros((total, states), bool)
    best_of = np.zeros(total, np.int32)
    value = np.zeros((len(order), states), np.float32)
    if begins is not None:
        value[np.arange(states) != begins[order][:, None]] = -penalty
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        v = value[:n]
        if t:
            top = v.argmax(axis=1)
            floor = v[np.arange(n), top] - penalty
            change = v < floor[:, None]
            switched[at], best_of[at] = change, top
            v = np.where(change, floor[:, None], v)
        v = v + scores[at]
        value[:n] = v - v.max(axis=1, keepdims=True)
    state = (value.argmax(axis=1) if ends is None else ends[order]).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        s = state[:n]
        labels[at] = s
        state[:n] = np.where(switched[at, s], best_of[at], s)
    return labels


def passes(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """For each sequence, and each state before it, the best value with which it ends in each state."""
    states, order = scores.shape[1], np.argsort(-counts, kind="stable")
    begin, length = (np.cumsum(counts) - counts)[order], counts[order]
    value = np.where(np.eye(states, dtype=bool), 0.0, -penalty)[None].repeat(len(counts), axis=0)
    active = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    for t, n in enumerate(active):
        v = value[:n]
        value[:n] = np.maximum(v, v.max(axis=2, keepdims=True) - penalty) + scores[begin[:n] + t][:, None]
    out = np.empty_like(value)
    out[order] = value
    return out


def _lowered(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _parts_of(text: str) -> Iterator[tuple[int, Words, np.ndarray]]:
    """The parts of a long text: where each begins, its words, and how many of them each chunk has."""
    at = 0
    for piece in common.pieces(text, PART_CHARS, LONGEST_WORD):
        w = words_of([_lowered(piece)])
        chunks, rest = divmod(len(w.first), CHUNK_WORDS)
        yield at, w, np.array([CHUNK_WORDS] * chunks + [rest] * bool(rest), np.int64)
        at += len(piece)


def label_long(model: Model, text: str) -> Iterator[tuple[Words, np.ndarray]]:
    """Words (with their places in the whole text) and labels of a long text, part by part."""
    value, came = np.zeros(len(model.languages)), []
    for _, w, counts in _parts_of(text):
        for through in passes(model.scores(w), counts, model.penalty) if len(counts) else ():
            total = value[:, None] + through
            came.append(total.argmax(axis=0).astype(np.int32))
            value = total.max(axis=0)
            value -= value.max()
    state = np.zeros(len(came) + 1, np.int32)  # before each chunk, and after the last
    state[-1] = value.argmax()
    for k in range(len(came) - 1, -1, -1):
        state[k] = came[k][state[k + 1]]
    done = 0
    for at, w, counts in _parts_of(text):
        n = len(counts)
        labels = viterbi(model.scores(w), counts, model.penalty, state[done : done + n], state[done + 1 : done + n + 1])
        done += n
        w.start, w.stop = w.start + at, w.stop + at
        yield w, labels


def label_short(model: Model, texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words and labels of texts that are not long: hashed part by part, labelled together, since many sequences share each step."""
    kept, scores = [], []
    for part in common.parts(texts, PART_CHARS):
        w = words_of([_lowered(texts[i]) for i in part])
        scores.append(model.scores(w))
        w.text += part[0]
        kept.append(w)
    none = np.zeros(0, np.int64)
    joined = [np.concatenate([getattr(w, k) for w in kept]) if kept else none for k in ("text", "letters", "script", "start", "stop")]
    words = Words(*joined[:3], none, none, none, *joined[3:])
    every = np.concatenate(scores) if scores else np.zeros((0, len(model.languages)), np.float32)
    return words, viterbi(every, np.bincount(words.text, minlength=len(texts)), model.penalty)


def label(model: Model, texts: list[str]) -> Iterator[tuple[Words, np.ndarray]]:
    """Words (``text`` counts within ``texts``) and labels: of all short texts at once, then of each long text in several parts."""
    numbers = [i for i, t in enumerate(texts) if len(t) <= PART_CHARS]
    words, labels = label_short(model, [texts[i] for i in numbers])
    words.text = np.array(numbers, np.int64)[words.text]
    yield words, labels
    for i, t in enumerate(texts):
        if len(t) > PART_CHARS:
            for words, labels in label_long(model, t):
                words.text = words.text + i
                yield words, labels


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score (its share of the letters) of each text."""
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    letters = np.zeros((len(texts), len(model.languages)))
    evidence = np.zeros(len(texts), bool)  # whether any word had a known script
    for w, labels in label(model, texts):
        np.add.at(letters, (w.text, labels), w.letters)
        evidence[w.text[model.uses.any(axis=1)[w.script]]] = True
    total = letters.sum(axis=1)
    best = np.where(evidence, letters.argmax(axis=1), model.order[0])
    share = np.where(evidence, letters[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best, total)], [float(s) if n else 0.0 for s, n in zip(share, total)]


def batch_bytes(model: Model) -> int:
    """Bytes of text labelled at once: scores are kept for each word and language."""
    return (4 << 20) // max(1, len(model.languages) // 16)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


COUNTS = "kind int, place long, n long"


def learn_from(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, penalty: float = SWITCH_PENALTY, most_languages: int = MOST_LANGUAGES) -> Model:
    """Learn from at most ``sample_docs`` distinct labelled texts of each language outside the held-out quarter."""
    rows = docs.filter((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), "lang", "text")
    totals = rows.select("h", "lang").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    totals = {r["lang"]: r["count"] for r in totals.collect()}  # at most ``most_languages`` rows
    names = sorted(totals)
    counts = Counts.none(len(names))
    if not names:
        return fitted(names, counts, penalty)
    counts.texts[:] = [totals[n] for n in names]
    quota = max(1, min(sample_docs, SAMPLE_TEXTS // len(names)))
    # A threshold on the hash lets about 1.5 quotas of each language pass, so what is gathered does not grow with the input.
    below = {k: -(1 << 63) + int((1 << 64) * min(1.0, 1.5 * quota / n)) - 1 for k, n in totals.items()}
    limits = F.create_map(*[F.lit(x) for k, v in below.items() for x in (k, v)])
    keys = rows.select("h", "lang").filter(F.col("h") <= limits[F.col("lang")]).distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keys = common.written(keys.withColumn("place", order).filter(F.col("place") <= quota).select("h", "lang"), "sampled")
    # At most ``SAMPLE_TEXTS`` keys (or one for each language) are sent along; copies of a text then count once.
    some = rows.join(F.broadcast(keys), ["h", "lang"], "left_semi").dropDuplicates(["h", "lang"]).select("lang", "text")
    number = {n: k for k, n in enumerate(names)}

    def count(batch: pa.RecordBatch):
        own = [number[x] for x in batch.column(0).to_pylist()]
        pieces = [(k, piece) for k, text in zip(own, batch.column(1).to_pylist()) for piece in common.pieces(text, PART_CHARS, LONGEST_WORD)]
        for part in common.parts([p for _, p in pieces], PART_CHARS):
            found = seen([pieces[i][1] for i in part], np.array([pieces[i][0] for i in part], np.int64), len(names))
            for kind, (at, n) in enumerate(found):
                yield {"kind": np.full(len(at), kind, np.int32), "place": at, "n": n}

    sums = common.map_batches(some, _parse_datatype_string(COUNTS), count).groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()  # no more rows than the tables have places
    for kind, table in enumerate(counts.tables()[:3]):
        own = sums.filter(pc.equal(sums["kind"], kind))
        table.reshape(-1)[own["place"].to_numpy()] = own["n"].to_numpy()
    return fitted(names, counts, penalty)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
SPANS = "doc_id long, first long, last long, lang string"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: ``MOST_ENTRIES`` numbers

    def work(batch: pa.RecordBatch):
        for part in common.slices(batch, "text", batch_bytes(shared.value)):
            languages, scores = predict(shared.value, common.texts_of(part.column(1)))
            yield {"doc_id": part.column(0), "held_out": part.column(2), "lang_pred": languages, "score": scores}

    rows = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return common.map_batches(rows, _parse_datatype_string(PREDICTED), work)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """The spans of one language in every text: character offsets (last exclusive) and language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        m = shared.value
        if not m.languages:
            return
        for part in common.slices(batch, "text", batch_bytes(m)):
            ids = part.column(0).to_pylist()
            last: dict = {}  # the span that a further part of the same text may carry on
            for w, labels in label(m, common.texts_of(part.column(1))):
                out = {"doc_id": [], "first": [], "last": [], "lang": []}
                new = np.flatnonzero(np.r_[True, (np.diff(w.text) != 0) | (np.diff(labels) != 0)]) if len(labels) else np.zeros(0, np.int64)
                ends = np.r_[new[1:] - 1, len(labels) - 1] if len(labels) else new
                for i, a, b, k in zip(w.text[new].tolist(), w.start[new].tolist(), w.stop[ends].tolist(), labels[new].tolist()):
                    if last and last["of"] == i and last["lang"] == m.languages[k]:
                        last["last"] = b
                        continue
                    if last:
                        add(out, ids, last)
                    last = {"of": i, "first": a, "last": b, "lang": m.languages[k]}
                yield out
            if last:
                yield add({"doc_id": [], "first": [], "last": [], "lang": []}, ids, last)

    def add(out: dict, ids: list, span: dict) -> dict:
        for k, v in zip(out, (ids[span["of"]], span["first"], span["last"], span["lang"])):
            out[k].append(v)
        return out

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(SPANS), work)
