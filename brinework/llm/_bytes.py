"""Vectorised work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POLY = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM_FACTOR = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
_PART = 1 << 20

#: Lower-cases A-Z and leaves other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII whitespace (space, tab to carriage return).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Letters, with all bytes of non-ASCII characters.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row offsets (null as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes; a longer row is alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``member`` bytes, and each row's range of runs.

    Runs never cross a row's end.  ``offsets`` start at 0.
    """
    inside = member[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX1
    h ^= h >> np.uint64(33)
    h *= _MIX2
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n + 1 of each."""
    if len(_powers.get("up", ())) <= n:
        size, inverse = max(1 << 16, 1 << int(n + 1).bit_length()), pow(_POLY, -1, 1 << 64)
        for name, base in (("up", _POLY), ("down", inverse)):
            out, step = np.ones(1, np.uint64), base
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step % (1 << 64)
            _powers[name] = out
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans wherever they stand.

    ``starts`` ascend.  Long input is taken in parts, so the tables of powers
    stay small unless a single span is long.
    """
    if len(data) > _PART and len(starts) > 1:
        cuts = np.searchsorted(starts, np.arange(_PART, len(data), _PART))
        parts = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(starts)], strict=True) if a < b]
        if len(parts) > 1:
            return np.concatenate([span_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], seed) for a, b in parts])
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ np.uint64(seed))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, one for each start that has n."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = words[:count] * _GRAM_FACTOR[0]
    for j in range(1, n):
        total = total + words[j : j + count] * _GRAM_FACTOR[j]
    return mix(total)


def spans_to_arrow(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column, without a Python object for each."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take]))).cast(pa.string())
