"""Dense text encoding: chunked, pooled, normalised; the encoder is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 1024) -> Encoder:
    """An offline encoder: signed counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
        return out

    return encode


def chunks_of(text: str, size: int, stride: int) -> list[str]:
    """A text in chunks of ``size`` white-space tokens; whole if it fits; blank as one empty chunk."""
    words = text.split()
    if not words:
        return [""]
    if len(words) <= size:
        return [text]
    return [" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - size + stride), stride) if i == 0 or i - stride + size < len(words)]


def pool(vectors: np.ndarray, how: str) -> np.ndarray:
    if not len(vectors):
        return np.zeros(vectors.shape[1])
    return vectors.max(0) if how == "max" else vectors.sum(0) / max(len(vectors), 1)


def embed(documents: DataFrame, key: str, text: str, encoder: Encoder | None = None, size: int = 384, stride: int = 384, how: str = "mean", batch: int = 64, present: str | None = None, dim: int = 1024) -> DataFrame:
    """(key, embedding array<double>): L2-normalised; zeros where ``present`` is false or null.

    Texts are encoded in Arrow batches; null texts count as empty.
    """
    encoder = encoder or hashing_encoder(dim)
    schema = f"{key} {dict(documents.dtypes)[key]}, embedding array<double>"
    columns = [key, text, *([present] if present else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [chunks_of(t if isinstance(t, str) else "", size, stride) for t in pdf[text]]
            flat = [c for p in parts for c in p]
            made = np.vstack([encoder(flat[i : i + batch]) for i in range(0, len(flat), batch)]) if flat else np.zeros((0, dim))
            out, at = [], 0
            for i, p in enumerate(parts):
                v = pool(made[at : at + len(p)], how)
                at += len(p)
                v = v / max(float(np.sqrt((v * v).sum())), 1e-12)
                out.append((np.zeros_like(v) if present and pdf[present].iloc[i] is not True and not bool(pdf[present].iloc[i] == True) else v).tolist())  # noqa: E712
            yield pd.DataFrame({key: pdf[key], "embedding": out})

    return documents.select(*columns).mapInPandas(run, schema)


def with_digest(vectors: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content, embedding): vectors with the digest of their text, as a cache holds them."""
    return vectors.join(documents.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content")), key).select(key, "content", "embedding")


def cached_embeddings(documents: DataFrame, cache: DataFrame, key: str, text: str, **options: object) -> DataFrame:
    """Cached vectors where the cache has the key and the text's digest, new ones for the rest."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = documents.withColumn("content", digest)
    hits = rows.join(cache, [key, "content"]).select(key, "content", "embedding")
    misses = rows.join(cache, [key, "content"], "left_anti")
    return hits.unionByName(embed(misses, key, text, **options).join(misses.select(key, "content"), key).select(key, "content", "embedding"))
