"""Vectors of tokens made into one vector of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("mean", "first", "max", "last")


def pooled_rows(tokens: np.ndarray, row: np.ndarray, valid: np.ndarray, count: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """One vector for each of ``count`` rows, and whether it has one.

    tokens: the vectors of all rows below each other, row: the row of each,
    ascending, valid: its mask.
    """
    out = np.zeros((count, tokens.shape[1]))
    if mode == "first":
        used = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[used]] = tokens[used]
        return out, np.isin(np.arange(count), row)
    used = np.flatnonzero(valid)
    owner = row[used]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    there = owner[starts]
    if mode == "mean":
        if len(starts):
            out[there] = np.add.reduceat(tokens[used], starts) / np.diff(np.append(starts, len(used)))[:, None]
        return out, np.isin(np.arange(count), row)
    if mode == "max" and len(starts):
        out[there] = np.maximum.reduceat(tokens[used], starts)
    if mode == "last" and len(starts):
        out[there] = tokens[used[np.append(starts[1:], len(used)) - 1]]
    return out, np.isin(np.arange(count), there)


def pooled(texts: DataFrame, mode: str = "mean", *, key: str = "chunk_id", tokens: str = "tokens", mask: str = "mask", normalise: bool = False) -> DataFrame:
    """(key, embedding): the tokens' vectors of each text (array of arrays) as one, those whose mask is 0 left out.

    ``mean`` and ``max`` by component, ``first`` the first token whatever its mask,
    ``last`` the last one that counts.  Without a token that counts the mean is a
    vector of zeros, max and last are null; a text without tokens is null.  A null
    mask counts every token.  All token vectors of a column have one length.
    One pass over Arrow batches: a text's matrix must fit a task.
    """
    if mode not in MODES:
        raise ValueError(f"unknown pooling {mode!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, masks = batch.column(1), batch.column(2)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
            inner = lists.flatten()
            matrix = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            matrix = matrix.reshape(len(inner), -1) if len(inner) else np.zeros((0, 1))
            known = np.repeat(masks.is_valid().to_numpy(zero_copy_only=False), sizes)
            valid = np.ones(len(inner), bool)
            # masks of rows that have tokens but no mask take no place in the flattened column
            flags = np.concatenate([np.asarray(m, bool)[:n] if m is not None else np.empty(0, bool) for m, n in zip(masks.to_pylist(), sizes, strict=True)]) if len(sizes) else np.empty(0, bool)
            valid[known] = flags
            out, there = pooled_rows(matrix, np.repeat(np.arange(len(sizes)), sizes), valid, len(sizes), mode)
            if normalise:
                out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            vectors = pa.array([v if ok else None for v, ok in zip(out, there, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "embedding"])

    rows = texts.select(key, tokens, F.col(mask).cast("array<int>").alias("mask")) if mask in texts.columns else texts.select(key, tokens, F.lit(None).cast("array<int>").alias("mask"))
    return rows.mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, embedding array<double>")
