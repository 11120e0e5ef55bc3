"""Embedding of chunk texts: distinct texts only, misses only, in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS, BATCH = 384, 32
Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimensions: int = DIMENSIONS) -> Callable[[], Embed]:
    """Factory of a deterministic embedder without a model: signed, hashed words and word pairs, unit length."""

    def load() -> Embed:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), np.float32)
            for i, text in enumerate(texts):
                words = re.findall(r"[^\W_]+", text.lower())
                for term in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                    h = zlib.crc32(term.encode())
                    out[i, h % dimensions] += 1.0 if h >> 31 else -1.0
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    return load


def embed_column(text: Column, load: Callable[[], Embed] | None = None) -> Column:
    """Vectors of texts; the model is loaded once per worker and sees ``BATCH`` texts at a time."""
    factory = load or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = factory()
        for texts in batches:
            vectors = [v for i in range(0, len(texts), BATCH) for v in embed(texts.iloc[i : i + BATCH].fillna("").tolist())]
            yield pd.Series(vectors, dtype=object)

    return run(text)


def embed_misses(texts: DataFrame, cache: DataFrame, model: str, load: Callable[[], Embed] | None = None) -> DataFrame:
    """New cache rows ``model, sha, dim, vector`` for the texts (``sha, text``) that the cache lacks, each sha once."""
    known = cache.where(F.col("model") == model).select("sha")
    misses = texts.select("sha", "text").dropDuplicates(["sha"]).join(known, "sha", "left_anti")
    return misses.select(F.lit(model).alias("model"), "sha", embed_column(F.col("text"), load).alias("vector")).withColumn("dim", F.size("vector"))
