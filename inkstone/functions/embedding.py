"""Embedders: a protocol of one call, and a model-free one that hashes character trigrams."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from inkstone.functions import text as T


def hash_vector(text: str | None, dimension: int = 512) -> np.ndarray:
    """Counts of character trigrams by CRC-32, at unit length; the zero vector for texts under three characters."""
    t = "".join((text or "").split())
    v = np.bincount([zlib.crc32(t[i : i + 3].encode()) % dimension for i in range(len(t) - 2)], minlength=dimension).astype("f4")
    n = np.linalg.norm(v)
    return v / n if n else v


def batch_embedder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A Column function from any encoder of a list of texts to a matrix; batches are Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embedded(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.fillna("").tolist())))

    return embedded


def hashing_embedder(dimension: int = 512) -> Callable[[Column], Column]:
    return batch_embedder(lambda texts: np.stack([hash_vector(t, dimension) for t in texts]) if texts else np.zeros((0, dimension), "f4"))


def embed_chunks(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(``chunk_id``, ``embedding``) of chunks' composed texts."""
    return chunks.select("chunk_id", embed(T.compose("subject", "text")).alias("embedding"))


def cached(embed: Callable[[DataFrame], DataFrame], store, limit: int) -> Callable[[DataFrame], DataFrame]:
    """An embedder of queries (``query_id``, ``prepared``) that keeps vectors by their text in a ``lifecycle.Generations``.

    Only texts that aren't kept are embedded, each once; of all used the ``limit`` used last are kept, and only usable
    vectors. A ``limit`` of 0 keeps none.
    """
    from inkstone.operators.search import usable
    from inkstone.session import materialize

    if limit < 1:
        return embed

    def embedded(queries: DataFrame) -> DataFrame:
        now = store.current()
        texts = queries.select("prepared").distinct()
        kept = store.read("vectors", now) if now else None
        known = texts.join(kept.select("prepared", "embedding"), "prepared") if kept else None
        missing = texts.join(kept, "prepared", "left_anti") if kept else texts
        named = missing.select(F.col("prepared").alias("query_id"), "prepared")
        fresh = materialize(embed(named).select(F.col("query_id").alias("prepared"), "embedding"), "fresh-vectors")
        used = (known.unionByName(fresh) if known else fresh).withColumn("used", F.lit((now or {}).get("generation", 0) + 1))
        older = kept.join(texts, "prepared", "left_anti").select(*used.columns) if kept else used.limit(0)
        table = materialize(used.where(usable("embedding")).unionByName(older).orderBy(F.desc("used"), "prepared").limit(limit), "kept-vectors")
        store.publish({"vectors": table}, {"limit": limit})
        return queries.join(used.select("prepared", "embedding"), "prepared").select("query_id", "embedding")

    return embedded
