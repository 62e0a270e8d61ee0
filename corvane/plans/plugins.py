"""Extension points: embedder, reranker and language model, with deterministic stand-ins that need no model."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corvane.operators.fusion import overlap


class Embedder(Protocol):
    dim: int

    def embed(self, text: Column) -> Column:
        """The vector of a text, as array<float>."""


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column:
        """How well a text answers a query."""


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


@functools.lru_cache(maxsize=30_000)
def _features(word: str, dim: int) -> list[tuple[int, float]]:
    hashes = [(zlib.crc32(feature.encode()), weight) for feature, weight in ((word, 1.0), (word[:4], 0.5))]
    return [(h % dim, weight if h >> 31 else -weight) for h, weight in hashes]


class HashEmbedder:
    """Signed feature hashing of words and of their first letters; equal texts get equal vectors in every process."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        dim = self.dim

        @pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            def one(t: str | None) -> np.ndarray:
                sums = [0.0] * dim
                for w, times in Counter(re.findall(r"[^\W_]+", (t or "").lower())).items():
                    for place, weight in _features(w, dim):
                        sums[place] += times * weight
                v = np.array(sums, dtype=np.float32)
                n = float(np.linalg.norm(v))
                return v / n if n else v

            return texts.map(one)

        return run(text)


class OverlapReranker:
    """Share of the query's words that a text has."""

    def score(self, query: Column, text: Column) -> Column:
        return overlap(query, text)


class BatchClient:
    """Calls a service with batches of texts inside executors: endpoints in turn, retries with growing waits, batches
    that are too large are halved."""

    def __init__(self, call: Callable[[str, list[str]], list], endpoints: list[str], retries: int = 3, wait_s: float = 0.5):
        self.call, self.endpoints, self.retries, self.wait_s, self.at = call, endpoints, retries, wait_s, 0

    def __call__(self, texts: list[str]) -> list:
        import time

        if not texts:
            return []
        for attempt in range(self.retries):
            endpoint = self.endpoints[self.at % len(self.endpoints)]
            self.at += 1
            try:
                return self.call(endpoint, texts)
            except OverflowError:
                if len(texts) == 1:
                    raise
                half = len(texts) // 2
                return self(texts[:half]) + self(texts[half:])
            except (ConnectionError, TimeoutError):
                if attempt + 1 == self.retries:
                    raise
                time.sleep(self.wait_s * 2**attempt)
        raise RuntimeError("unreachable")


def embed_table(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, embedding) of chunks (chunk_id, content)."""
    return chunks.select(F.col("chunk_id").alias("id"), embedder.embed(F.col("content")).alias("embedding"))
