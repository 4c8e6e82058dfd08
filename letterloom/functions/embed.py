"""Embedding providers: a protocol, an offline one that hashes words, and an optional one for sentence models."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 768


@runtime_checkable
class EmbeddingProvider(Protocol):
    dimension: int
    model: str
    revision: str

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...

    def encode_query(self, text: str) -> np.ndarray: ...


class HashingProvider:
    """Signed feature hashing of words and word pairs, normalised to length one. Needs no files and is the same everywhere."""

    model, revision = "hashing", "1"

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            words = re.findall(r"[^\W_]+", (text or "").lower())
            for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(token)
                row[h % self.dimension] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    def encode_query(self, text: str) -> np.ndarray:
        return self.encode([text])[0]


class SentenceProvider:
    """A sentence-transformers model, by name or alias and at a pinned revision. The library is optional and loaded where
    texts are encoded: only name and revision travel to the workers. Query and document prefixes serve models trained with them."""

    ALIASES = {"small": "sentence-transformers/all-MiniLM-L6-v2", "large": "sentence-transformers/all-mpnet-base-v2"}

    def __init__(self, dimension: int = DIMENSION, model: str = "large", revision: str = "main", query_prefix: str = "", document_prefix: str = ""):
        self.dimension, self.model, self.revision = dimension, self.ALIASES.get(model, model), revision
        self.query_prefix, self.document_prefix, self._loaded = query_prefix, document_prefix, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def _vectors(self, texts: Sequence[str]) -> np.ndarray:
        if self._loaded is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as missing:
                raise RuntimeError("the sentence provider needs the sentence-transformers package") from missing
            self._loaded = SentenceTransformer(self.model, revision=self.revision)
        out = np.asarray(self._loaded.encode(list(texts), normalize_embeddings=True), np.float32)
        if out.shape[1] != self.dimension:
            raise ValueError(f"{self.model} gives {out.shape[1]} dimensions, not {self.dimension}")
        return out

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return self._vectors([self.document_prefix + (t or "") for t in texts])

    def encode_query(self, text: str) -> np.ndarray:
        return self._vectors([self.query_prefix + text])[0]


PROVIDERS = {"hashing": HashingProvider, "sentence": SentenceProvider}


def provider(name: str = "hashing", **options) -> EmbeddingProvider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)


def embedded(text: Column, by: EmbeddingProvider) -> Column:
    """The vector of each text; the provider travels once to each worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(by.encode(batch.fillna("").tolist())), index=batch.index)

    return encode(text)
