"""Pluggable text embedding as an Arrow-batched column."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_small

Embedder = Callable[[Sequence[str]], "Sequence[Sequence[float] | None] | None"]


def hashed_words(dims: int = 64) -> Embedder:
    """Offline stand-in for a model: a unit vector of hashed word counts, None for a blank text."""

    def embed(texts: Sequence[str]) -> list[np.ndarray | None]:
        out = []
        for text in texts:
            slots = [zlib.crc32(w.encode()) % dims for w in text.lower().split()]
            counts = np.bincount(slots, minlength=dims).astype(np.float64) if slots else None
            out.append(None if counts is None else counts / np.linalg.norm(counts))
        return out

    return embed


def tried(embed: Embedder, texts: list[str]) -> list:
    """Vectors of all texts, None for those that the provider refuses. Every text is asked for, a refused batch in halves."""
    out: list = [None] * len(texts)
    parts = [(0, len(texts))]
    while parts:
        low, high = parts.pop()
        if low == high:
            continue
        try:
            found = embed(texts[low:high])
        except Exception:  # a broken provider must not fail the job
            found = None
        if found is not None and len(found) == high - low:
            out[low:high] = list(found)
        elif high - low > 1:
            parts += [((low + high) // 2, high), (low, (low + high) // 2)]
    return out


def embed_column(df: DataFrame, embed: Embedder | None = None, *, text: str = "text", out: str = "embedding") -> DataFrame:
    """Set ``out`` to the vector of ``text``.

    ``embed`` takes a batch of texts. If it fails, returns None or returns the wrong number of
    vectors, the batch is tried again in halves, so that only texts it cannot take stay NULL; later
    operators fall back to text for those. Without a provider all vectors are NULL.
    """
    if embed is None:
        return df.withColumn(out, F.lit(None).cast("array<float>"))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna().to_numpy()
            result = pd.Series([None] * len(batch), dtype=object)
            result[np.flatnonzero(known)] = pd.Series(
                [None if v is None else np.asarray(v, np.float32) for v in tried(embed, batch[known].tolist())],
                index=np.flatnonzero(known), dtype=object,
            )
            yield result

    return spread_small(df).withColumn(out, vectors(F.col(text)))


def embed_missing(df: DataFrame, embed: Embedder, *, text: str = "text") -> DataFrame:
    """``embedding`` of rows that have none; the others keep theirs."""
    if "embedding" not in df.columns:
        return embed_column(df, embed, text=text)
    asked = embed_column(df.withColumn("_ask", F.when(F.col("embedding").isNull(), F.col(text))), embed, text="_ask", out="_new")
    return asked.withColumn("embedding", F.coalesce("embedding", "_new")).drop("_ask", "_new")
