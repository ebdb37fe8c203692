"""Embedding (E1) and L2 normalisation.

The embedder is a pluggable Arrow batch job: a *factory* is called once per Python worker
(model load), and the loaded function maps a batch of texts to a matrix.  No model weights
ship with the engine, so the built-in embedder is feature hashing of lower-cased letter/digit
runs into 384 buckets (md5 based, so the SQL oracle can repeat it).  It returns integer
counts; cosine scores on counts are exact integers over one square root, identical on every
engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docshield.functions import vectors as V

_TOKEN = None


def _token_re():
    """Runs of Unicode letters and digits: ``[^\\W_]`` is Python's word class without the
    underscore, i.e. the same set as ``[\\p{L}\\p{N}]`` used by the native and SQL forms."""
    global _TOKEN
    if _TOKEN is None:
        import re
        _TOKEN = re.compile(r"[^\W_]+")
    return _TOKEN


_BUCKETS: dict[int, dict[str, int]] = {}
_BUCKET_CACHE_MAX = 1 << 17
#: Texts that are Python strings at a time.
TEXTS_HELD = 256


def hash_counts(texts, dim: int = V.HASH_DIM) -> np.ndarray:
    """Count matrix (n x dim) of md5 feature buckets.  A token -> bucket cache lives in the
    Python worker (reused across batches and tasks, cleared once it passes ``_BUCKET_CACHE_MAX``
    entries, about 20 MB) so md5 calls follow the frequent words, not the token count; counting is
    one ``bincount`` per text."""
    rx = _token_re()
    out = np.zeros((len(texts), dim), dtype=np.int32)
    cache = _BUCKETS.setdefault(dim, {})
    for r, t in enumerate(texts):
        if len(cache) > _BUCKET_CACHE_MAX:
            cache.clear()
        if not t:
            continue
        toks = rx.findall(t.lower())
        if not toks:
            continue
        for w in set(toks).difference(cache):
            cache[w] = int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % dim
        ids = np.fromiter(map(cache.__getitem__, toks), dtype=np.int64, count=len(toks))
        out[r] = np.bincount(ids, minlength=dim)
    return out


def hashing_embed(df: DataFrame, text: str, out: str = "vec", dim: int = V.HASH_DIM) -> DataFrame:
    """E1 built-in: ``out`` = array<int> counts, ``out_norm2`` = sum of squares (bigint).  The counts
    of a batch are one block of Arrow memory; its texts are taken ``TEXTS_HELD`` at a time."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def embed_counts(s: pa.Array) -> pa.Array:
        m = np.zeros((len(s), dim), dtype=np.int32)
        for at in range(0, len(s), TEXTS_HELD):
            m[at:at + TEXTS_HELD] = hash_counts(s.slice(at, TEXTS_HELD).to_pylist(), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * dim), pa.array(m.reshape(-1)))

    v = embed_counts(F.col(text))
    return (df.withColumn(out, v)
              .withColumn(out + "_norm2", F.aggregate(F.col(out), F.lit(0).cast("bigint"),
                                                      lambda a, x: a + x * x)))


def embed(df: DataFrame, text: str, out: str, factory: Callable[[], Callable[[list], np.ndarray]],
          dim: int) -> DataFrame:
    """E1 pluggable: ``factory()`` loads a model once per worker; batches go through it."""
    from collections.abc import Iterator

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for s in batches:
            m = np.asarray(fn(s.tolist()), dtype=np.float32).reshape(len(s), dim)
            yield pd.Series(list(m))

    return df.withColumn(out, run(F.col(text)))


def l2_normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """E2 as an operator (native ``transform``/``aggregate``)."""
    return df.withColumn(out or col, V.l2_normalize(F.col(col)))
