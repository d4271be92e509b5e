"""Texts to unit vectors by feature hashing.

Tokens are cut on the JVM and cross to Python as Arrow lists.  Distinct tokens are hashed and numpy passes build the dense
vectors, some rows and a bounded number of tokens at a time.  The step is narrow: no shuffle, no per-row Python.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


# Rows and tokens that are counted at once; a longer text is counted alone.
PASS_ROWS, PASS_TOKENS = 512, 1 << 20


@lru_cache(1 << 16)
def _bucket(word: str, dim: int) -> int:
    return int(md5(word.encode()).hexdigest()[:8], 16) % dim


def _unit_vectors(token_lists: pa.Array, lengths: np.ndarray, dim: int) -> np.ndarray:
    n = len(token_lists)
    words = token_lists.flatten().dictionary_encode()
    buckets = np.array([_bucket(w, dim) for w in words.dictionary.to_pylist()], dtype=np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    flat = rows * dim + (buckets[np.asarray(words.indices)] if len(rows) else rows)
    counts = np.bincount(flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def _unit_vector_udf(dim: int):
    @F.arrow_udf("array<float>")
    def unit_vectors(token_lists: pa.Array) -> pa.Array:
        n = len(token_lists)
        lengths = np.asarray(token_lists.value_lengths().fill_null(0), dtype=np.int64)
        ends = np.cumsum(lengths)
        unit = np.empty((n, dim), np.float32)
        start = 0
        while start < n:
            most = np.searchsorted(ends, ends[start] - lengths[start] + PASS_TOKENS, "right")
            end = max(start + 1, min(start + PASS_ROWS, int(most)))
            unit[start:end] = _unit_vectors(token_lists.slice(start, end - start), lengths[start:end], dim)
            start = end
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return unit_vectors


def embed_text(text: Column, dim: int = fixed.VECTOR_DIM) -> Column:
    """Term-frequency vector over hashed tokens, L2-normalised, as ``array<float>``."""
    return _unit_vector_udf(dim)(tokens(text))
