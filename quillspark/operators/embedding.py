"""Vectors of texts from a provider: only texts that the cache lacks are embedded."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillspark.functions import text as X
from quillspark.shared import Scratch

#: Length of the offline provider's vectors.
DIMS = 256

Embedder = Callable[[Column], Column]


_WORD = re.compile(r"\w+")
_CASE = re.compile("(?<=[a-z0-9])(?=[A-Z])")
_STOP = set(X.STOPWORDS)


def _terms(word: str) -> list[str]:
    """The search terms of one word, as X.search_tokens has them."""
    low = word.lower()
    if low.replace("_", " ") in _STOP:
        return []
    parts = [p.lower() for p in re.split(r"[\s_]+", _CASE.sub(" ", word)) if len(p) > 1]
    return [low, *[p for p in parts if p != low and p not in _STOP]]


def hashed(text: Column, dims: int = DIMS) -> Column:
    """The offline provider: search terms counted in ``dims`` cells by their MD5, with a sign; length 1, or all zero where there is no term."""

    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[tuple[int, int]]] = {}

        def cells(word: str) -> list[tuple[int, int]]:
            if word not in known:
                digests = [hashlib.md5(t.encode()).hexdigest() for t in _terms(word)]
                known[word] = [(int(h[:8], 16) % dims, 1 if int(h[8], 16) % 2 == 0 else -1) for h in digests]
            return known[word]

        def one(t: str) -> np.ndarray:
            v = np.zeros(dims)
            for word, n in Counter(_WORD.findall(unicodedata.normalize("NFC", t))).items():
                for at, sign in cells(word):
                    v[at] += sign * n
            return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def embed(texts: DataFrame, key: str, text: str, cache: DataFrame, scratch: Scratch, embedder: Embedder = hashed, model: str = "hashed") -> tuple[DataFrame, DataFrame]:
    """Vectors of texts and the rows to add to the cache: (key, embedding) for each row, (content, embedding) for new texts.

    The cache (content, embedding) is keyed by the digest of model and text. Each missing text is embedded once, however
    often it repeats. Null texts have no vector.
    """
    keyed = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), X.content_key(F.lit(model), F.col(text)).alias("content"))
    missing = keyed.select("content", "_text").join(cache.select("content"), "content", "left_anti").groupBy("content").agg(F.first("_text").alias("_text"))
    new = scratch.save(missing.select("content", embedder(F.col("_text")).alias("embedding")), "embedded")
    every = cache.select("content", "embedding").unionByName(new)
    return keyed.select(key, "content").join(every, "content").select(key, "embedding"), new


def set_embeddings(table: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """table with the embeddings of ``vectors`` (key, embedding), stored as floats, where it has one; vectors of unknown keys have no effect."""
    new = vectors.select(key, F.col("embedding").cast("array<float>").alias("_new")).dropDuplicates([key])
    return table.join(new, key, "left").select(*[F.coalesce("_new", "embedding").alias("embedding") if c == "embedding" else F.col(c) for c in table.columns])
