"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch are cut once; those whose count is not known yet are
held as one ragged array of symbol ids, with the rank of every adjacent pair.
Each round takes each sequence's lowest rank, merges all occurrences of that
pair in all sequences at once (from the left where they overlap), and looks up
only the pairs beside a merge anew.  Sequences without a pair left are counted
and leave the array.

One sequence takes as many rounds as it uses ranks, so a long pre-token is cut
into blocks that are merged side by side.  A block also holds so many bytes
before and after its own that what it says of its end is stable (the lookahead
that the merge list calls for).  Where two neighbours agree on a symbol boundary
in what they share, the first one's symbols up to it and the second one's from it
on are those of the whole; where they don't (a run of one letter may be out of
step), the second block is merged again from a boundary of the first.

Defined results
---------------
* null text: empty, 0 tokens; empty table: no rows; extra columns are ignored;
* very long texts and pre-tokens: whole; they enter the arrays in blocks of bounded size;
* special strings inside texts count as one token, as in the library's default;
* repeated rows and ties: equal texts give equal rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from sablewick.llm import common
from sablewick.llm.bpe import sufficient_lookahead
from sablewick.llm.pretokens import byte_letters, pretokenizer

#: Pre-tokens whose count is kept, the longest that is, and symbols held in one ragged array.
KEPT, KEPT_CHARS, BLOCK_SYMBOLS = 300_000, 64, 1 << 20
#: Pre-tokens of more bytes than this are cut into blocks of so many.
LONG_BLOCK = 2048
NO_RANK = np.int64(1) << 40


class RankArrays:
    """Merge ranks as sorted arrays, and the merging itself."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["end_of_word_suffix"]:
            raise ValueError("only vocabularies without a word-end suffix are counted")
        names: dict[str, int] = {c: i for i, c in enumerate(byte_letters())}
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        for a, b in pairs:
            names.setdefault(a + b, len(names))
        self.width = np.int64(len(names) + 1)
        self.reach = sufficient_lookahead(pairs) + 1
        keys = np.array([names[a] * int(self.width) + names[b] for a, b in pairs], np.int64)
        made = np.array([names[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int64), made

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the surviving symbols of the pieces begin (in the joined bytes), and of which piece each is."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        place = np.arange(len(symbols))
        begins = np.ones(len(symbols), bool)
        ranks = np.full(len(symbols), NO_RANK)  # of each symbol with the next one
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[:-1] != owner[1:]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest < NO_RANK
            if not live.all():  # finished sequences leave the array
                keep = np.repeat(live, sizes)
                symbols, owner, ranks, place = symbols[keep], owner[keep], ranks[keep], place[keep]
                sizes, lowest = sizes[live], lowest[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # Of overlapping occurrences (a a a) every second one counts, from the left.
            linked = np.r_[False, np.diff(at) == 1]
            if linked.any():
                first = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made_by_rank[ranks[at]]
            begins[place[at + 1]] = False
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, owner, ranks, place = symbols[stay], owner[stay], ranks[stay], place[stay]
            at -= np.arange(len(at))  # where the merged symbols stand now
            beside = np.unique(np.r_[at[at > 0] - 1, at])
            next_one = np.minimum(beside + 1, len(symbols) - 1)
            paired = (beside < next_one) & (owner[beside] == owner[next_one])
            ranks[beside] = NO_RANK
            beside, next_one = beside[paired], next_one[paired]
            ranks[beside] = self.rank_of(symbols[beside], symbols[next_one])
        found = np.flatnonzero(begins)
        return found, np.repeat(np.arange(len(pieces)), lengths)[found]

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each piece (each of at least one byte)."""
        return np.bincount(self.merged(pieces)[1], minlength=len(pieces))

    def count_long(self, piece: bytes) -> int:
        """Surviving symbols of one long piece, in blocks that are merged together."""
        n, total, from_place = len(piece), 0, 0
        for group in range(0, n, BLOCK_SYMBOLS):
            # Each block: where its bytes begin, where they end, and up to where its boundaries are stable.
            spans = []
            for k in range(group, min(n, group + BLOCK_SYMBOLS), LONG_BLOCK):
                end = min(n, k + LONG_BLOCK + self.reach)
                spans.append((max(0, k - self.reach), end, end - self.reach if end < n else n))
            at, of = self.merged([piece[a:b] for a, b, _ in spans])
            base = np.cumsum([0, *(b - a for a, b, _ in spans)])
            first = np.searchsorted(of, np.arange(len(spans) + 1))  # ``of`` ascends
            for k, (a, _, stable) in enumerate(spans):
                own = at[first[k] : first[k + 1]] - base[k] + a  # places in the whole piece
                # ``from_place`` is a true boundary; this block knows the rest if it has that boundary too.
                if from_place not in own and from_place:
                    end = min(n, max(from_place, stable) + self.reach)
                    own = self.merged([piece[from_place:end]])[0] + from_place
                    stable = end - self.reach if end < n else n
                known = own[(own >= from_place) & (own < stable)]
                if stable == n:
                    return total + len(known)
                if len(known):
                    # The boundary that the next block is likeliest to share is the last one.
                    total += len(known) - 1
                    from_place = int(known[-1])
        return total


class Counter:
    """Token counts for one tokenizer file."""

    def __init__(self, path: str):
        self.cutter = pretokenizer(path)
        self.arrays = RankArrays(self.cutter.spec)
        self.kept: dict[str, int] = {}

    def _learn(self, unknown: set[str]) -> dict[str, int]:
        """Counts of pieces that are not kept yet, in blocks of bounded size."""
        found: dict[str, int] = {}
        block: list[str] = []
        raw: list[bytes] = []
        held = 0

        def flush():
            found.update(zip(block, self.arrays.count(raw).tolist()))
            block.clear(), raw.clear()

        for piece in unknown:
            data = piece.encode()
            if len(data) > 2 * LONG_BLOCK:
                found[piece] = self.arrays.count_long(data)
                continue
            block.append(piece)
            raw.append(data)
            held += len(data)
            if held >= BLOCK_SYMBOLS:
                flush()
                held = 0
        if block:
            flush()
        return found

    def count_batch(self, texts: list[str]) -> list[int]:
        """Token counts of texts; their pieces meet in shared arrays."""
        cut, unknown = [], set()
        special = [0] * len(texts)
        for i, text in enumerate(texts):
            own: list[str] = []
            for segment in self.cutter.segments(text):
                if isinstance(segment, int):
                    special[i] += 1
                else:
                    own += segment
            cut.append(own)
            unknown.update(own)
        kept = self.kept
        unknown.difference_update(kept)
        found = self._learn(unknown) if unknown else {}
        if len(kept) + len(found) > KEPT:
            here = {p: kept[p] for own in cut for p in own if p in kept}
            kept.clear()
            found |= here
        kept.update(found)
        get = kept.__getitem__
        counts = [n + sum(map(get, own)) for n, own in zip(special, cut)]
        for piece in [p for p in found if len(p) > KEPT_CHARS]:
            kept.pop(piece, None)
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than ``limit`` tokens."""

    def work(batch: pa.RecordBatch):
        c = counter(path)
        for part in common.slices(batch, "text"):
            texts = common.texts_of(part.column(1))
            n = c.count_batch(texts)
            yield {"doc_id": part.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(COUNTS), work)
