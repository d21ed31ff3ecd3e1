"""Vector arithmetic on ARRAY columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brinework.functions.text import _col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null for a null, 0 for different lengths or a zero vector."""
    a, b = _col(a), _col(b)
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def normalised(a: str | Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    a = _col(a)
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def hashed_embedding(words: str | Column, dimension: int = 64, seed: int = 0) -> Column:
    """A unit vector from word hashes: each word adds a signed one at its place; no words give zeros.

    An Arrow-batched UDF: one pass over the words, where array functions would
    pass over them once for each dimension.
    """

    @F.pandas_udf("array<double>")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for words in lists:
            v = np.zeros(dimension)
            if words is not None and len(words):
                h = pd.util.hash_array(np.asarray(words, object), categorize=False) ^ np.uint64(seed)
                v = np.bincount((h % np.uint64(dimension)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dimension)
                size = np.sqrt(v @ v)
                v = v / size if size else v
            out.append(v)
        return pd.Series(out, dtype=object)

    return run(_col(words))


def prefixed(c: str | Column, role: str) -> Column:
    """Text as an encoder expects it: ``query: `` or ``passage: `` in front."""
    if role not in ("query", "passage"):
        raise ValueError(f"role is query or passage, not {role!r}")
    return F.concat(F.lit(f"{role}: "), _col(c))
