"""Pre-tokens of the public BPE tokenizers, cut exactly as their library cuts them.

Texts whose characters all lie below U+0180 (and a few marks above) take a
compiled pattern with the character classes written out; all other texts go
through the library's own normaliser and pre-tokenizer.  Both give the same
pieces (tests hold them against each other).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Character classes up to U+017F, written out.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "
#: U+0130 lower-cases to two characters.
OTHER = re.compile("[^\x00-įı-ſ–—‘-„…]")
WORD_PIECES = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
BYTE_PIECES = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: A text is cut before a single space between these into parts of about this many characters.
PART_CHARS = 1 << 18


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, ...]:
    """The printable character that stands for each byte in byte-level vocabularies, by their published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


@lru_cache(maxsize=1)
def letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


def printable(raw: bytes) -> str:
    table = byte_letters()
    return "".join([table[b] for b in raw])


def unprintable(s: str) -> bytes:
    table = letter_bytes()
    return bytes([table[c] for c in s])


def parts(text: str):
    """The text in consecutive parts of bounded length, cut where no pre-token and no normalisation crosses.

    The cut is before a single space between letters or digits of any script, or
    between a letter and a punctuation mark, for scripts that set no spaces.  A
    text without such a place, as one that is a single pre-token, stays whole.
    """
    at = 0
    while len(text) - at > PART_CHARS:
        m = SAFE_CUT.search(text, at + PART_CHARS - 1)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


# Letters that every version of the Unicode tables has as such: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
OLD_LETTERS = "a-zA-ZÀ-ÖØ-öø-ſΑ-ΡΣ-Ωα-ωА-яא-תء-غअ-हก-ฮぁ-ゖァ-ヺ一-龥가-힣"
SAFE_CUT = re.compile(rf"\w(?= \w)|[{OLD_LETTERS}](?=[.,;:!?。，、；：！？…])")


class PreTokenizer:
    """Cuts texts into pre-tokens for one tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.lower = self.spec["normalizer"] is not None
        self.pieces = WORD_PIECES if self.lower else BYTE_PIECES
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special string."""
        if OTHER.search(text) is None:
            return self.pieces.findall(text.lower() if self.lower else text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [unprintable(p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str):
        """Lists of pre-tokens, and ids of special strings as ints, in order and in parts of bounded length."""
        found = self.at_special.split(text) if "<|" in text else [text]
        for k, segment in enumerate(found):
            if k % 2:
                yield self.special[segment]
            elif segment:
                for part in parts(segment):
                    yield self.split(part)


@lru_cache(maxsize=4)
def pretokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)
