"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

How far a later byte can reach back is computed from the merge list alone.  Let
two inputs agree up to some place.  Applying rule (a, b) can move the place
where their segmentations part to the left by at most len(a), and only if b
begins at that place; after an earlier rule (a', b') moved it there, the symbol
that begins there has a' on its left spine.  So the reach is the heaviest chain
of rules with rising ranks in which each b has the previous a on its left
spine, counted in len(a).  ``sufficient_lookahead`` finds it in one pass.

``StreamingEncoder`` holds the bytes of the unfinished pre-token only: once its
buffer is longer than the lookahead, tokens that end before the last
``lookahead`` bytes are stable and are emitted.  ``StreamingDecoder`` turns
byte-level tokens into text with an incremental UTF-8 state machine;
``JoinedDecoder`` turns emitted ids into the library's decoded text, part by part.

A transducer's output for a whole short pre-token depends on that pre-token
only, so it is kept in a table of bounded size.

Defined results
---------------
* null text: empty, no ids; empty table: no rows; extra columns are ignored;
* very long texts and pre-tokens: whole, in bounded parts and buffers;
* special strings inside texts become their ids, as in the library's default;
* repeated rows and ties: equal texts give equal rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from sablewick.llm import common
from sablewick.llm.pretokens import letter_bytes, pretokenizer, printable

#: Pre-tokens whose output is kept, and the longest that is.
KEPT, KEPT_CHARS = 200_000, 64
#: Pre-tokens longer than this are fed and put out in slices of so many characters.
SLICE_CHARS = 1 << 14
#: Buffers up to this many symbols are merged by scanning, longer ones with a heap.
SHORT, NONE = 48, 1 << 60


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Most symbols by which a later symbol can change an earlier segmentation."""
    spine: dict[str, tuple[str, ...]] = {}
    heaviest: dict[str, int] = {}
    most = 0
    for a, b in merges:
        chain = len(a) + max((heaviest.get(s, 0) for s in (b, *spine.get(b, ()))), default=0)
        heaviest[a] = max(heaviest.get(a, 0), chain)
        most = max(most, chain)
        spine.setdefault(a + b, (a, *spine.get(a, ())))
    return most


class Merges:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        cut = len(self.suffix)
        plain = [(a, b[:-cut] if cut and b.endswith(self.suffix) else b) for a, b in pairs]
        # The suffix marks the last symbol of a word; the one symbol that has it or not counts on top.
        self.lookahead = sufficient_lookahead(plain if cut else pairs) + bool(cut)
        self.names = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def apply(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until no rule applies."""
        if len(symbols) > SHORT:
            return self._apply_heap(symbols)
        get, none = self.ranks.get, NONE
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _apply_heap(self, symbols: list[str]) -> list[str]:
        """The same with a heap over a linked list, for long buffers."""
        n, get = len(symbols), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not symbols[i] or get((symbols[i], symbols[j])) != rank:
                continue  # this pair is gone
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s in symbols if s]


class StreamingEncoder:
    """Encodes one pre-token that arrives in pieces, holding at most about twice the lookahead."""

    def __init__(self, merges: Merges):
        self.merges, self.buffer = merges, ""

    def push(self, piece: str) -> list[str]:
        """Feed printable byte letters; returns the tokens that became stable."""
        out: list[str] = []
        step = self.merges.lookahead + 1
        for k in range(0, len(piece), step):
            self.buffer += piece[k : k + step]
            if len(self.buffer) > 2 * step:
                at = 0
                for token in self.merges.apply(list(self.buffer)):
                    if at + len(token) > len(self.buffer) - step:
                        break
                    out.append(token)
                    at += len(token)
                self.buffer = self.buffer[at:]
        return out

    def finish(self) -> list[str]:
        """The end of the pre-token: the tokens left."""
        symbols = list(self.buffer)
        self.buffer = ""
        if symbols and self.merges.suffix:
            symbols[-1] += self.merges.suffix
        return self.merges.apply(symbols)


class StreamingDecoder:
    """Byte-level tokens to text; bytes of an unfinished character are held back (at most three)."""

    def __init__(self, suffix: str = ""):
        self.suffix, self.state = suffix, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def push(self, token: str) -> str:
        ends = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if ends else token
        table = letter_bytes()
        raw = bytes(table[c] for c in body) if all(c in table for c in body) else body.encode()
        return self.state.decode(raw) + (" " if ends else "")

    def finish(self) -> str:
        return self.state.decode(b"", True)


class JoinedDecoder:
    """Ids to the text that the library decodes from them: tokens joined by spaces, ids in parts."""

    def __init__(self, names: dict[int, str]):
        self.names, self.begun = names, False

    def push(self, ids: bytes) -> str:
        """Feed little-endian ids; returns the text that they add."""
        get = self.names.get
        tokens = [t for i in struct.unpack(f"<{len(ids) // 4}I", ids) if (t := get(i)) is not None]
        if not tokens:
            return ""
        joined = " ".join(tokens)
        if self.begun:
            return " " + joined
        self.begun = True
        return joined


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        self.cutter = pretokenizer(path)
        self.merges = Merges(self.cutter.spec)
        self.kept: dict[str, bytes] = {}

    def slices(self, piece: str):
        """Ids (little-endian) of one pre-token as they become stable, slice by slice."""
        ids, stream = self.merges.ids, StreamingEncoder(self.merges)
        for k in range(0, len(piece), SLICE_CHARS):
            tokens = stream.push(printable(piece[k : k + SLICE_CHARS].encode()))
            if k + SLICE_CHARS >= len(piece):
                tokens += stream.finish()
            # A symbol that the vocabulary lacks has no id: the library drops it, as there is no unknown token.
            numbers = [ids[t] for t in tokens if t in ids]
            yield struct.pack(f"<{len(numbers)}I", *numbers)

    def output(self, piece: str) -> bytes:
        """Ids (little-endian) of one pre-token."""
        found = self.kept.get(piece)
        if found is None:
            found = b"".join(self.slices(piece))
            if len(piece) <= KEPT_CHARS:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = found
        return found

    def stream(self, text: str):
        """Ids as bytes for each part of a text, in order."""
        get, output = self.kept.get, self.output
        for segment in self.cutter.segments(text):
            if isinstance(segment, int):
                yield struct.pack("<I", segment)
            elif segment and len(text) > SLICE_CHARS and max(map(len, segment)) > SLICE_CHARS:
                for p in segment:
                    yield from self.slices(p) if len(p) > SLICE_CHARS else (output(p),)
            elif segment:
                # A pre-token of no ids is kept as empty bytes, so None alone means not kept.
                yield b"".join([output(p) if (ids := get(p)) is None else ids for p in segment])

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in struct.unpack(f"<{len(ids) // 4}I", ids)]

    def decode_joined(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, joined by spaces."""
        return " ".join(self.merges.names[i] for i in ids if i in self.merges.names)

    def decode_text(self, ids: list[int]) -> str:
        """The text itself, from the byte-to-text state machine; a space after each word end."""
        machine = StreamingDecoder(self.merges.suffix)
        return "".join([machine.push(self.merges.names[i]) for i in ids]) + machine.finish()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and the text decoded from the ids by the state machine."""

    def work(batch: pa.RecordBatch):
        c = codec(path)
        for part in common.slices(batch, "text"):
            ids = [c.encode(t) for t in common.texts_of(part.column(1))]
            yield {"doc_id": part.column(0), "ids": ids, "decoded": [c.decode_text(i) for i in ids]}

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(ENCODED), work)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each text's ids and of the text that the library's decode gives for them.

    Ids are hashed and decoded as the transducer emits them, so a text's whole
    output is never held.
    """

    def work(batch: pa.RecordBatch):
        c = codec(path)
        for part in common.slices(batch, "text"):
            counts, id_digests, text_digests = [], [], []
            for text in common.texts_of(part.column(1)):
                n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), JoinedDecoder(c.merges.names)
                for emitted in c.stream(text):
                    ids.update(emitted)
                    decoded.update(decoder.push(emitted).encode())
                    n += len(emitted) // 4
                counts.append(n)
                id_digests.append(ids.hexdigest())
                text_digests.append(decoded.hexdigest())
            yield {"doc_id": part.column(0), "n_tokens": counts, "ids_sha256": id_digests, "decoded_sha256": text_digests}

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(DIGESTS), work)
