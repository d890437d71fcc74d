"""Toxicity: a bidirectional gated recurrent network over overlapping windows.

Each word enters as two learned inputs side by side: an embedding of the word
and the sum of those of its character 3- to 5-grams (both hashed, so both tables
have a fixed size).  A GRU reads each window forwards, another backwards;
attention pools their states, and a logistic unit scores the window.  All
overlapping windows of a text are scored, and the text's score is the highest.

The network starts from small random values and is trained in numpy, on the
driver: back-propagation through time, Adam for the dense parameters and Adagrad
for the rows of the embeddings.  A toxic text says nothing about which of its
windows is toxic, so training scores all windows of a text and spreads the loss
over them by a smooth maximum; which window, and which word in it, is found by
the gradient alone.  From the second pass on a toxic text weighs as much as the
network bears its label out, so that mislabelled rows are not learned by heart.

Learning rows are bounded in number and in bytes: ``sample_docs`` texts of each
class (distinct ones, those with the smallest hash), and of a text longer than
``sample_chars`` that many characters in evenly spread slices, cut out in the
executors.

Defined results
---------------
* null, empty and letterless texts: one window of no words, scored by the
  output unit's bias, so a low score;
* very long texts: all windows, in parts of bounded size; words that a part
  leaves over go before the next, so the result is that of the uncut text; a run
  of more than ``LONGEST_WORD`` letters is several words;
* rows with a null label are not learned from; a null doc_id is not held out;
* labels repeated for a document: toxic if any of them is; a text that bears both
  labels, as several documents, is learned with each;
* if a class is missing among the labelled rows, every score is that class's;
* repeated rows: learned once; equal texts get equal scores; empty table: no rows;
* extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from sablewick.llm import common
from sablewick.llm.langid import remainder

SAMPLE_DOCS, SAMPLE_CHARS = 2000, 8192
WINDOW, STRIDE = 32, 24
WORD_BITS, GRAM_BITS, DIM, HIDDEN = 16, 17, 8, 8
#: Passes over the sample; with few rows, more of them, until this share of either class is told rightly or so many steps are done.
EPOCHS, MOST_STEPS, ENOUGH = 2, 160, 0.95
LEAST_WINDOWS, BATCH_WINDOWS, RATE, WORD_RATE, GRAM_RATE, DROP_WORDS, START_SCALE = 64, 512, 0.01, 0.05, 0.017, 0.1, 0.05
#: Least weight of a toxic text that scores low (labels hold some noise), and most of a clean one for being rarer in the sample than in the corpus.
LEAST_WEIGHT, MOST_WEIGHT = 0.05, 4.0
BLOCK_WINDOWS, BLOCK_WORDS, PART_CHARS, LONGEST_WORD = 4096, 1 << 16, 1 << 18, 4096
U = np.uint64

ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000)


def _mix(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return ((x * U(0x94D049BB133111EB)) >> U(64 - bits)).astype(np.int64)


@dataclass
class Batch:
    """The words of several texts: distinct ones with their inputs, and where they stand."""

    counts: np.ndarray  # words per text
    which: np.ndarray  # number of the distinct word, in text order
    word: np.ndarray  # bucket of each distinct word
    grams: list[np.ndarray]  # buckets per place (bucket 0: none), for n = 3, 4, 5
    first: np.ndarray  # where each distinct word's places begin
    key: np.ndarray  # 64 bits of each distinct word
    start: np.ndarray | None = None  # where each word stands in its lower-cased text
    stop: np.ndarray | None = None

    @property
    def size(self) -> np.ndarray:
        """Places of each distinct word."""
        return np.diff(np.r_[self.first, len(self.grams[0])])


def cut(texts: list[str]) -> Batch:
    """Lower-case, cut into runs of letters and digits (immediate repetitions once), and hash."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ALNUM[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        inside[i] = chr(int(codes[i])).isalnum()
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if len(start) and (stop - start).max() > LONGEST_WORD:
        many = -(-(stop - start) // LONGEST_WORD)
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start, stop = np.repeat(start, many) + step * LONGEST_WORD, np.repeat(stop, many)
        stop = np.minimum(stop, start + LONGEST_WORD)
    begins = np.cumsum([0, *(len(t) + 1 for t in low)])
    owner = np.searchsorted(begins, start, "right") - 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Batch(np.zeros(len(texts), np.int64), none, none, [none] * 3, none, np.zeros(0, U), none, none)
    size = stop - start
    chars = codes[inside].astype(U)
    at = np.cumsum(size) - size
    place = (np.arange(len(chars)) - np.repeat(at, size)).astype(U)
    key = np.add.reduceat((chars + U(0x9E37)) * (place * U(2) + U(0x9E3779B97F4A7C15)) ** U(3), at)
    # A word said again at once adds nothing; left in, long stammering would drive the states to their limits.
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
    key, start, size = key[new], start[new], size[new]
    shift = begins[owner[new]]
    counts = np.bincount(owner[new], minlength=len(texts))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    # The distinct words, each between two marks.
    n = size[one]
    first = np.cumsum(n + 2) - (n + 2)
    padded = np.zeros(int((n + 2).sum()), U)
    owner = np.repeat(np.arange(len(one)), n + 2)
    padded[first], padded[first + n + 1] = U(1), U(2)
    take = np.repeat(start[one] - first - 1, n + 2) + np.arange(len(padded))
    letters = padded == 0
    padded[letters] = codes[take[letters]].astype(U)
    grams, rolling = [], padded.copy()
    for k in range(1, 5):
        rolling[:-k] = rolling[:-k] * U(0x100000001B3) + padded[k:]
        if k >= 2:
            bucket = _mix(rolling + U(k), GRAM_BITS)
            bucket = np.maximum(bucket, 1)
            bucket[len(padded) - k :] = 0
            bucket[: len(padded) - k][owner[: len(padded) - k] != owner[k:]] = 0
            grams.append(bucket)
    return Batch(counts, which.astype(np.int32), _mix(key[one], WORD_BITS), [g.astype(np.int32) for g in grams], first, key[one], start - shift, start + size - shift)


def places(b: Batch, words: np.ndarray) -> np.ndarray:
    """The places of some distinct words, one word after another."""
    size = b.size[words]
    return np.repeat(b.first[words] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def cut_all(texts: list[str]) -> Batch:
    """``cut`` for many texts, part by part, with their distinct words joined."""
    some = [cut([texts[i] for i in part]) for part in common.parts(texts, PART_CHARS)]
    key, one, back = np.unique(np.concatenate([b.key for b in some]), return_index=True, return_inverse=True)
    begin = np.cumsum([0, *(len(b.key) for b in some)])
    of = np.searchsorted(begin, one, "right") - 1
    order = np.argsort(of, kind="stable")  # take each part's words together
    rank = np.empty(len(one), np.int64)
    rank[order] = np.arange(len(one))
    word, grams, size = [], [[], [], []], []
    for k, b in enumerate(some):
        mine = one[order][of[order] == k] - begin[k]
        at = places(b, mine)
        word.append(b.word[mine])
        size.append(b.size[mine])
        for into, g in zip(grams, b.grams):
            into.append(g[at])
    size = np.concatenate(size)
    which = [rank[back[begin[k] + b.which]].astype(np.int32) for k, b in enumerate(some)]
    return Batch(np.concatenate([b.counts for b in some]), np.concatenate(which), np.concatenate(word), [np.concatenate(g) for g in grams], np.cumsum(size) - size, key[order])


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of every overlapping window; a text without words has one empty window."""
    many = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), many)
    step = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = step * STRIDE
    return text, first, np.minimum(WINDOW, counts[text] - first)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Parameters by name; all of them float32.  Both directions are stacked: direction 0 reads forwards."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        """Small random values everywhere; only the output's bias says that most windows are clean."""
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        p = {"word": f(1 << WORD_BITS, DIM, s=START_SCALE), "gram": f(1 << GRAM_BITS, DIM, s=START_SCALE / 3)}
        p |= {"w": f(2 * DIM, 6 * h, s=0.3), "b": np.zeros(6 * h, np.float32), "u": f(2, h, 3 * h, s=0.3)}
        p |= {"attend": f(2 * h, s=0.1), "out": f(2 * h, s=0.3), "bias": np.full(1, -1, np.float32)}
        p["gram"][0] = 0
        return Network(p)

    def inputs(self, b: Batch) -> np.ndarray:
        """The joined word and character input of each distinct word."""
        if not len(b.first):
            return np.zeros((0, 2 * DIM), np.float32)
        out = np.empty((len(b.first), 2 * DIM), np.float32)
        ends = np.r_[b.first, len(b.grams[0])]
        for k in range(0, len(b.first), BLOCK_WORDS):
            to = min(len(b.first), k + BLOCK_WORDS)
            some = slice(ends[k], ends[to])
            out[k:to, :DIM] = self.p["word"][b.word[k:to]]
            out[k:to, DIM:] = np.add.reduceat(sum(self.p["gram"][g[some]] for g in b.grams), b.first[k:to] - ends[k], axis=0)
        return out

    def forward(self, gates: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows given each distinct word's gate inputs; ``length`` must descend.

        ``index`` holds the words of the windows, one row each.
        """
        p, h = self.p, HIDDEN
        n, longest = len(index), int(length[0]) if len(length) else 0
        if not longest:
            return np.full(n, p["bias"][0], np.float32), None
        steps, rows = np.arange(longest), np.arange(n)
        there = np.maximum(length[:, None] - 1 - steps, 0)  # where the backward direction stands at each step
        x = np.empty((longest, 2, n, 3 * h), np.float32)
        x[:, 0] = gates[index[:, :longest], : 3 * h].transpose(1, 0, 2)
        x[:, 1] = gates[index[rows[:, None], there], 3 * h :].transpose(1, 0, 2)
        active = np.searchsorted(-length, -steps, "left")
        read = np.zeros((longest, 2, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        kept = []
        for t in range(longest):
            m = active[t]
            old, now = state[:, :m], x[t, :, :m]
            a = old @ p["u"]
            zr = sigmoid(now[..., : 2 * h] + a[..., : 2 * h])
            new = np.tanh(now[..., 2 * h :] + zr[..., h:] * a[..., 2 * h :])
            if keep:
                kept.append((old.copy(), zr, a[..., 2 * h :], new))
            state[:, :m] = new + zr[..., :h] * (old - new)
            read[t, :, :m] = state[:, :m]
        states = np.concatenate([read[:, 0], read[there.T, 1, rows]], axis=2)  # by place
        beyond = steps[:, None] >= length
        e = states @ p["attend"]
        e[beyond] = -1e9
        e = np.exp(e - e.max(axis=0))
        e[beyond] = 0
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return logit, (states, weight, pooled, kept, active, there, beyond) if keep else None

    def backward(self, grad: np.ndarray, index: np.ndarray, cache, many: int) -> dict[str, np.ndarray]:
        """Gradients of all parameters above the gate inputs, and of those inputs (of ``many`` distinct words)."""
        p, h = self.p, HIDDEN
        states, weight, pooled, kept, active, there, beyond = cache
        longest, n = weight.shape
        rows = np.arange(n)
        g = {"out": grad @ pooled, "bias": np.array([grad.sum()], np.float32), "u": np.zeros_like(p["u"])}
        by_pool = grad[:, None] * p["out"]
        dot = np.einsum("tnk,nk->tn", states, by_pool)
        by_e = weight * (dot - (weight * dot).sum(axis=0))
        g["attend"] = np.einsum("tn,tnk->k", by_e, states)
        by_state = weight[:, :, None] * by_pool + by_e[:, :, None] * p["attend"]
        by_read = np.stack([by_state[:, :, :h], by_state[there.T, rows, h:]], axis=1)
        by_x = np.zeros((longest, 2, n, 3 * h), np.float32)
        carry, back = np.zeros((2, n, h), np.float32), p["u"].transpose(0, 2, 1)
        for t in range(longest - 1, -1, -1):
            m = active[t]
            old, zr, a_new, new = kept[t]
            z, r = zr[..., :h], zr[..., h:]
            dh = carry[:, :m] + by_read[t, :, :m]
            d_new = dh * (1 - z) * (1 - new * new)
            d_zr = [dh * (old - new) * z * (1 - z), d_new * a_new * r * (1 - r)]
            by_x[t, :, :m] = np.concatenate([*d_zr, d_new], axis=2)
            d_a = np.concatenate([*d_zr, d_new * r], axis=2)
            g["u"] += old.transpose(0, 2, 1) @ d_a
            carry[:, :m] = dh * z + d_a @ back
        live = ~beyond.T
        gates = np.zeros((many, 6 * h), np.float32)
        for d, at in enumerate((index[:, :longest], index[rows[:, None], there])):
            word, value = at[live], by_x[:, d].transpose(1, 0, 2)[live]
            for k in range(3 * h):
                gates[:, d * 3 * h + k] = np.bincount(word, value[:, k], many)
        return g | {"gates": gates}

    def window_logits(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window, and its text."""
        text, first, length = windows(b.counts)
        base = (np.cumsum(b.counts) - b.counts)[text] + first
        gates = self.inputs(b) @ self.p["w"] + self.p["b"]
        order = np.argsort(-length, kind="stable")
        logits = np.zeros(len(text), np.float32)
        for k in range(0, len(order), BLOCK_WINDOWS):
            some = order[k : k + BLOCK_WINDOWS]
            logits[some] = self.forward(gates, gather(b, base[some], length[some]), length[some])[0]
        return logits, text

    def highest(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each of some texts that are cut together."""
        logits, text = self.window_logits(cut(texts))
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, text, logits)
        return best

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window score of each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best = np.zeros(len(texts))
        for part in common.parts(texts, PART_CHARS):
            if len(part) == 1 and len(texts[part[0]]) > PART_CHARS:
                best[part] = max(self.highest([piece])[0] for piece in overlapping(texts[part[0]]))
            else:
                best[part] = self.highest([texts[i] for i in part])
        return sigmoid(best)


def overlapping(text: str) -> Iterator[str]:
    """A long text in pieces that have, together, the windows of the whole text and no other.

    The words from the first window on that a piece cannot fill, with a word to
    spare, are left over and go before the next piece.
    """
    left = ""
    pieces = common.pieces(text, PART_CHARS, LONGEST_WORD)
    now = next(pieces)
    for following in pieces:
        low = left + now.lower()
        b = cut([low])
        n = len(b.which)
        whole = (n - WINDOW - 1) // STRIDE + 1 if n > WINDOW else 0  # windows that end before the last word
        if whole:
            last = (whole - 1) * STRIDE + WINDOW - 1
            yield low[: b.stop[last]]
        left = "".join(low[i:j] + " " for i, j in zip(b.start[whole * STRIDE :].tolist(), b.stop[whole * STRIDE :].tolist()))
        now = following
    yield left + now


def gather(b: Batch, base: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The distinct words of windows, one row each; places beyond a window's length repeat its last word."""
    if not len(b.which):
        return np.zeros((len(base), 1), np.int64)
    at = base[:, None] + np.minimum(np.arange(WINDOW), np.maximum(length - 1, 0)[:, None])
    return b.which[np.minimum(at, len(b.which) - 1)]


def auc(labels: np.ndarray, scores: np.ndarray) -> float:
    """The share of (1, 0) pairs that scores rank rightly, ties by half."""
    _, inverse, times = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[inverse]
    ones = int(labels.sum())
    return float((rank[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones)))


def train(texts: list[str], labels: list[int], clean_weight: float = 1.0, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit a network to texts and their 0/1 labels; a clean text weighs ``clean_weight``."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    toxic = np.array(labels, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        net.constant = float(toxic[0]) if len(toxic) else 0.0
        return net
    p, b = net.p, cut_all(texts)
    if not len(b.first):
        net.constant = float(toxic.mean() >= 0.5)
        return net
    size, (text, first, length) = b.size, windows(b.counts)
    base = (np.cumsum(b.counts) - b.counts)[text] + first
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("word", "gram")}
    squares = {k: np.full(len(p[k]), 1e-6, np.float32) for k in ("word", "gram")}
    weight, seen, told = np.where(toxic == 1, 1.0, clean_weight), np.zeros(len(texts)), np.zeros(len(texts), bool)
    batch = min(BATCH_WINDOWS, max(LEAST_WINDOWS, len(text) // 16))
    step = epoch = 0
    while epoch < epochs or (step < MOST_STEPS and min(told[toxic == 1].mean(), told[toxic == 0].mean()) < ENOUGH):
        epoch += 1
        order = r.permutation(len(texts))
        ends = np.cumsum(np.diff(begin)[order])
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(batch, ends[-1] + batch, batch)), len(order)])
        for docs in np.split(order, cuts[1:-1]):
            many = np.diff(begin)[docs]
            some = np.repeat(begin[docs] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            own = np.repeat(np.arange(len(docs)), many)
            sort = np.argsort(-length[some], kind="stable")
            some, own = some[sort], own[sort]
            step += 1
            if not length[some[0]]:
                continue
            distinct, index = np.unique(gather(b, base[some], length[some]), return_inverse=True)
            index, at = index.reshape(len(some), -1), places(b, distinct)
            sub = Batch(b.counts, b.which, b.word[distinct], [g[at] for g in b.grams], np.cumsum(size[distinct]) - size[distinct], b.key[distinct])
            stays = (r.random(len(distinct)) >= DROP_WORDS).astype(np.float32)[:, None]  # whole words are left out at random
            x = net.inputs(sub) * stays
            logit, cache = net.forward(x @ p["w"] + p["b"], index, length[some], keep=True)
            # Smooth maximum over a text's windows: the log of their mean odds.
            top = np.full(len(docs), -np.inf, np.float32)
            np.maximum.at(top, own, logit)
            odds = np.exp(logit - top[own])
            total = np.bincount(own, odds, len(docs))
            seen[docs], told[docs] = sigmoid(top + np.log(total / many)), (top >= 0) == toxic[docs]
            by_text = (seen[docs] - toxic[docs]) * weight[docs] / len(docs)
            g = net.backward((by_text[own] * odds / total[own]).astype(np.float32), index, cache, len(distinct))
            by_gates = g.pop("gates")
            by_x = (by_gates @ p["w"].T) * stays
            g |= {"w": x.T @ by_gates, "b": by_gates.sum(axis=0)}
            for name, value in g.items():
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.01 * (value * value - v)
                p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            # Embeddings: a rate of their own per row, touching this batch's rows only.
            gram_rows = np.repeat(np.arange(len(distinct)), size[distinct])
            for name, rows, value, rate in (("word", sub.word, by_x[:, :DIM], WORD_RATE), *(("gram", gr, by_x[gram_rows, DIM:], GRAM_RATE) for gr in sub.grams)):
                row, inverse = np.unique(rows, return_inverse=True)
                summed = np.stack([np.bincount(inverse, value[:, k], len(row)) for k in range(DIM)], axis=1).astype(np.float32)
                squares[name][row] += (summed * summed).mean(axis=1)
                p[name][row] -= rate * summed / (np.sqrt(squares[name][row])[:, None] + 1e-4)
            p["gram"][0] = 0
        if epoch >= 2:
            weight = np.where(toxic == 1, np.maximum(seen, LEAST_WEIGHT), clean_weight)
    return net


def learn_from(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Network:
    """Train on at most ``sample_docs`` distinct labelled texts of each class outside the held-out fifth."""
    known = labels.filter((remainder(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Texts stay where they are: the look-up takes hashes only, and each text's smallest id stands for its copies.
    marked = rows.select(F.col("doc_id"), F.xxhash64("text").alias("h")).join(known, F.col("doc_id") == F.col("id"))
    marked = common.written(marked.groupBy("h", "toxic").agg(F.min("id").alias("id")), "labelled")
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    bad, fine = (common.bounded_sample(marked.filter(F.col("toxic") == k), sample_docs, totals.get(k, 0), F.col("h")) for k in (1, 0))
    # At most 2 * sample_docs short rows, so this broadcast does not grow with the input; each brings at most sample_chars.
    some = F.broadcast(bad.unionByName(fine).select("id", F.col("h").alias("own"), "toxic"))

    def shorten(batch: pa.RecordBatch):
        return {"h": batch.column(0), "text": [common.slices_of(t, sample_chars) for t in common.texts_of(batch.column(1))], "toxic": batch.column(2)}

    found = rows.join(some, F.col("doc_id") == F.col("id")).filter(F.xxhash64("text") == F.col("own")).select("own", "text", "toxic")
    found = common.map_batches(found, _parse_datatype_string("h long, text string, toxic int"), shorten).dropDuplicates(["h", "toxic"])
    found = found.toArrow().sort_by([("h", "ascending"), ("toxic", "ascending")])
    taken = {k: min(sample_docs, n) for k, n in totals.items()}
    rarer = (totals.get(0, 0) / max(1, taken.get(0, 0))) / (totals.get(1, 0) / max(1, taken.get(1, 0)) or 1)
    return train(found["text"].to_pylist(), found["toxic"].to_pylist(), min(MOST_WEIGHT, max(1.0, rarer)))


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # tables of fixed size, about 7 MB

    def work(batch: pa.RecordBatch):
        for part in common.slices(batch, "text"):
            s = shared.value.score(common.texts_of(part.column(1)))
            yield {"doc_id": part.column(0), "held_out": part.column(2), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    rows = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    return common.map_batches(rows, _parse_datatype_string(SCORES), work)
