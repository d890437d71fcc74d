"""Embedders: text to vectors in Arrow batches.

``HashEmbedder`` is the default and needs no model: each token adds +1 or -1 to
one of ``dim`` buckets (both from its MD5), and the sum is scaled to length 1.
Remote providers are described in ``PROVIDERS``; each needs a callable that
fetches vectors for a batch of texts, since this engine makes no network calls
of its own.
"""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sablewick.functions import values
from sablewick.functions.text import TOKEN

CHARS_PER_TOKEN = 4


class Embedder(ABC):
    """Turns texts into vectors of one dimension."""

    provider = "none"
    max_tokens = 8192
    batch_size = values.EMBED_BATCH

    @property
    @abstractmethod
    def dimension(self) -> int: ...

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """One row per text."""

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([self.prepared(text)])[0].tolist()

    def detect_dimension(self) -> int:
        return len(self.embed("test"))

    def prepared(self, text: str | None) -> str:
        """Empty becomes one space; longer texts are cut to what the model takes."""
        return (text or " ")[: self.max_tokens * CHARS_PER_TOKEN]

    def column(self, on_error: str = "fail"):
        """A vectorised function from a text column to array<float>, ``batch_size`` texts at a time.

        A batch that fails is tried once more; then it fails the task (which Spark
        tries again), or with ``on_error='skip'`` its texts get a null vector.
        """
        if on_error not in ("fail", "skip"):
            raise ValueError(f"on_error is 'fail' or 'skip', not {on_error!r}")
        batch = self.batch_size

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                found: list = []
                for k in range(0, len(texts), batch):
                    some = [self.prepared(t) for t in texts.iloc[k : k + batch]]
                    try:
                        try:
                            rows = self.embed_batch(some)
                        except Exception:
                            rows = self.embed_batch(some)
                        found += list(rows.astype(np.float32))
                    except Exception:
                        if on_error == "fail":
                            raise
                        found += [None] * len(some)
                yield pd.Series(found, dtype=object)

        return vectors


#: Tokens whose buckets are kept.
KEPT_TOKENS = 1_000_000


class Buckets(dict):
    """Bucket and sign of tokens as one number, computed when first asked for."""

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode()).hexdigest()
        if len(self) >= KEPT_TOKENS:
            self.clear()
        self[token] = found = int(digest[:8], 16) * 2 + int(digest[8], 16) % 2
        return found


BUCKETS, FIND_TOKENS = Buckets(), re.compile(TOKEN)


class HashEmbedder(Embedder):
    """Signed feature hashing; takes whole texts."""

    provider, max_tokens, batch_size = "hash", 1 << 40, 2000

    def __init__(self, dim: int = 64):
        self.dim = dim

    @property
    def dimension(self) -> int:
        return self.dim

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """All tokens of the batch in one array, looked up text by text; then one weighted count."""
        many: list[int] = []

        def tokens() -> Iterator[list[str]]:
            for t in texts:
                found = FIND_TOKENS.findall(t.lower())
                many.append(len(found))
                yield found

        at = np.fromiter(map(BUCKETS.__getitem__, chain.from_iterable(tokens())), np.int64)
        row = np.repeat(np.arange(len(texts)), many)
        out = np.bincount(row * self.dim + (at >> 1) % self.dim, 1.0 - 2.0 * (at & 1), len(texts) * self.dim).reshape(len(texts), self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1, norms)


@dataclass
class Provider:
    """A remote provider's defaults: model, dimension and most tokens by model, and what else it offers."""

    model: str
    dimensions: dict[str, int] = field(default_factory=dict)
    max_tokens: int = 8192
    truncatable: tuple[int, ...] = ()
    tokens: dict[str, int] = field(default_factory=dict)  # by the beginning of a model's name
    input_type: str | None = None

    def tokens_of(self, model: str) -> int:
        longest = max((name for name in self.tokens if model.startswith(name)), key=len, default=None)
        return self.tokens[longest] if longest else self.max_tokens


# Public defaults of embedding providers.
VOYAGE_DIMENSIONS = {
    "voyage-3-large": 1024, "voyage-3.5": 1024, "voyage-3.5-lite": 1024, "voyage-code-3": 1024, "voyage-finance-2": 1024, "voyage-law-2": 1024,
    "voyage-multilingual-2": 1024, "voyage-large-2-instruct": 1024, "voyage-large-2": 1536, "voyage-code-2": 1536, "voyage-3": 1024, "voyage-3-lite": 512,
    "voyage-2": 1024, "voyage-02": 1024, "voyage-01": 1024, "voyage-lite-01": 1024, "voyage-lite-01-instruct": 1024, "voyage-lite-02-instruct": 1024,
}
VOYAGE_TOKENS = {"voyage-law-2": 16000, "voyage-large-2": 16000, "voyage-code-2": 16000, "voyage-2": 4000, "voyage-0": 4000, "voyage-lite-0": 4000}
PROVIDERS = {
    "OpenAI": Provider("text-embedding-3-small", {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}),
    "VoyageAI": Provider("voyage-code-3", VOYAGE_DIMENSIONS, 32000, tokens=VOYAGE_TOKENS, input_type="document"),
    "Gemini": Provider("gemini-embedding-001", {"gemini-embedding-001": 3072}, 2048, (3072, 1536, 768, 256)),
    "Ollama": Provider("nomic-embed-text", {"nomic-embed-text": 768}, 2048, tokens={"nomic-embed-text": 8192, "snowflake-arctic-embed": 8192}),
}


class RemoteEmbedder(Embedder):
    """A provider's model behind a callable ``fetch(texts, model) -> vectors``.

    Where a provider tells kinds of input apart (``input_type``), that is a third argument.
    """

    def __init__(self, provider: str, fetch: Callable[..., list[list[float]]], model: str | None = None, dimension: int | None = None, max_tokens: int | None = None, input_type: str | None = None):
        known = PROVIDERS[provider]
        if dimension is not None and known.truncatable and dimension not in known.truncatable:
            raise ValueError(f"{provider} offers the dimensions {known.truncatable}")
        self.provider, self.model = provider, model or known.model
        self.max_tokens, kind = max_tokens or known.tokens_of(self.model), input_type or known.input_type
        self.fetch = fetch if kind is None else lambda texts, model: fetch(texts, model, kind)
        self._dimension = dimension or known.dimensions.get(self.model)

    @property
    def dimension(self) -> int:
        if self._dimension is None:
            self._dimension = len(self.fetch(["test"], self.model)[0])
        return self._dimension

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        found = np.asarray(self.fetch(texts, self.model), np.float64)
        if found.shape[1] > self.dimension and not PROVIDERS[self.provider].truncatable or found.shape[1] < self.dimension:
            raise ValueError(f"{self.provider} {self.model} gave vectors of {found.shape[1]}, not {self.dimension}")
        return found[:, : self.dimension]


def embedder(provider: str = "hash", **options) -> Embedder:
    """An embedder by provider name."""
    if provider == "hash":
        return HashEmbedder(**options)
    if provider not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {provider!r}; known: hash, {', '.join(PROVIDERS)}")
    return RemoteEmbedder(provider, **options)


def embedder_from(get: Callable[[str], str | None], fetch: Callable[..., list[list[float]]]) -> Embedder:
    """The embedder that settings name: ``EMBEDDING_PROVIDER``, and ``EMBEDDING_MODEL`` (of Ollama first ``OLLAMA_MODEL``)."""
    provider = get("EMBEDDING_PROVIDER") or "OpenAI"
    model = (get("OLLAMA_MODEL") if provider == "Ollama" else None) or get("EMBEDDING_MODEL")
    return embedder(provider, fetch=fetch, model=model) if provider != "hash" else embedder()
