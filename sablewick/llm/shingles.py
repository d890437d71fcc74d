"""Sets of hashed word shingles and their MinHash signatures, in numpy over whole batches.

Words are lower-cased runs of letters and digits.  A text of at least
``SHINGLE`` words has the set of its runs of that many words; a shorter text has
one shingle of all its words; a text without words has the empty set.
"""

from __future__ import annotations

import hashlib

import numpy as np

from sablewick.llm import common

SHINGLE, HASHES = 5, 96
PART_CHARS, LONGEST_WORD = 1 << 18, 4096
U = np.uint64

ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000)
_seeds = np.random.default_rng(20240229)
MULTIPLY = _seeds.integers(1, 1 << 63, HASHES, dtype=np.uint64) | U(1)
ADD = _seeds.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the number of words of each text."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ALNUM[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        inside[i] = chr(int(codes[i])).isalnum()
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in low)])
    counts = np.bincount(np.searchsorted(begins, start, "right") - 1, minlength=len(texts))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    size = stop - start
    at = np.cumsum(size) - size
    chars = codes[inside].astype(U)
    place = (np.arange(len(chars)) - np.repeat(at, size)).astype(U)
    return mix(np.add.reduceat(mix(chars + (place << U(32))), at) + size.astype(U)), counts


def _of_words(words: np.ndarray, shingle: int) -> np.ndarray:
    n = min(shingle, len(words))
    if not n:
        return words
    many = len(words) - n + 1
    h = np.full(many, U(n))
    for k in range(n):
        h = h * U(0x9E3779B97F4A7C15) + words[k : k + many]
    return np.unique(mix(h))


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    out = []
    for part in common.parts(texts, PART_CHARS):
        if len(part) == 1 and len(texts[part[0]]) > PART_CHARS:  # a long text: its words are hashed piece by piece
            some = [word_hashes([piece])[0] for piece in common.pieces(texts[part[0]], PART_CHARS, LONGEST_WORD)]
            out.append(_of_words(np.concatenate(some), shingle))
            continue
        words, counts = word_hashes([texts[i] for i in part])
        ends = np.cumsum(counts)
        out += [_of_words(words[e - n : e], shingle) for n, e in zip(counts.tolist(), ends.tolist())]
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """MinHash signatures (uint32), one row per set; an empty set's row is all ones."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    held, rows, size = [], [], 0

    def flush():
        flat = np.concatenate(held)
        at = np.cumsum([0, *(len(h) for h in held[:-1])])
        for k in range(HASHES):
            h = ((flat * MULTIPLY[k] + ADD[k]) >> U(32)).astype(np.uint32)
            least = np.minimum.reduceat(h, at)
            np.minimum.at(out[:, k], rows, least)

    for i, s in enumerate(sets):
        for k in range(0, len(s), block):
            piece = s[k : k + block]
            held.append(piece)
            rows.append(i)
            size += len(piece)
            if size >= block:
                flush()
                held, rows, size = [], [], 0
    if held:
        flush()
    return out
