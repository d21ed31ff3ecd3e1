"""A small convolutional text network in numpy: embeddings, filters of several widths, max pooling.

Symbols are integers (bytes, or hash buckets of words).  ``hashes`` symbols
stand for one position; their embeddings add up.  Scoring multiplies the
embedding table with each filter row once, so a convolution is a sum of table
look-ups; training follows the gradient through the positions of the maxima.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_LOW = np.float32(-1e9)


@dataclass
class Bank:
    """Embeddings and convolution filters.

    embedding: (symbols, d); the last symbol is padding and embeds to zero.
    filters: for each width w an array (w, d, F).
    """

    embedding: np.ndarray
    filters: list[np.ndarray]
    pair: bool = False
    _tables: list[list[np.ndarray]] = field(default_factory=list, repr=False)

    @classmethod
    def random(cls, symbols: int, d: int, widths: tuple[int, ...], per_width: int, seed: int, pair: bool = False) -> Bank:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.3, (symbols + 1, d)).astype(np.float32)
        embedding[-1] = 0
        return cls(embedding, [rng.normal(0, (2 / (w * d)) ** 0.5, (w, d, per_width)).astype(np.float32) for w in widths], pair)

    @property
    def pad(self) -> int:
        return len(self.embedding) - 1

    @property
    def size(self) -> int:
        return sum(f.shape[2] for f in self.filters)

    @property
    def reach(self) -> int:
        """Padding that a text needs after its last symbol."""
        return max(f.shape[0] for f in self.filters) - 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": []}

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the look-up tables of its steps; with ``pair`` two symbols are looked up at once."""
        if not self._tables:
            for f in self.filters:
                single = [np.ascontiguousarray(self.embedding @ f[j]) for j in range(f.shape[0])]
                if self.pair:
                    n = len(self.embedding)
                    single = [(a[:, None, :] + b[None, :, :]).reshape(n * n, -1) for a, b in zip(single[::2], single[1::2], strict=True)]
                self._tables.append(single)
        return self._tables

    def segment_max(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        """Largest response of each filter in each segment, (segments, filters).

        ids: (positions,) or (positions, hashes), at least ``reach`` pads after
        the last segment.  Segments ascend and don't overlap; a response belongs
        to the segment that holds its first position.  Works in blocks.
        """
        if ids.ndim == 1:
            ids = ids[:, None]
        out = np.full((len(starts), self.size), _LOW, np.float32)
        step = 2 if self.pair else 1
        for low in range(0, int(ends[-1]) if len(ends) else 0, block):
            high = min(low + block, int(ends[-1]))
            a, b = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            if a >= b:
                continue
            s, e = np.maximum(starts[a:b], low) - low, np.minimum(ends[a:b], high) - low
            full = s < e
            edges = np.stack([s[full], e[full]], 1).ravel()
            part = ids[low : high + self.reach]
            if self.pair:
                part = part[:-1] * len(self.embedding) + part[1:]
            n, at = high - low, 0
            for tables in self.tables():
                z = None
                for j, t in enumerate(tables):
                    for h in range(part.shape[1]):
                        got = t.take(part[j * step : j * step + n, h], axis=0)
                        z = got if z is None else np.add(z, got, out=z)
                top = np.maximum.reduceat(np.concatenate([z, z[-1:]]), edges, axis=0)[::2]
                rows = np.arange(a, b)[full]
                out[rows, at : at + z.shape[1]] = np.maximum(out[rows, at : at + z.shape[1]], top)
                at += z.shape[1]
        return out

    def forward(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima and their positions, for training batches."""
        if ids.ndim == 1:
            ids = ids[:, None]
        x = self.embedding[ids[:, 0]]
        for h in range(1, ids.shape[1]):
            x += self.embedding[ids[:, h]]
        n = len(x) - self.reach
        every = np.concatenate([f.transpose(0, 2, 1).reshape(-1, f.shape[1]) for f in self.filters]) @ x.T
        top, where, row = [], [], 0
        for f in self.filters:
            w, _, size = f.shape
            z = every[row : row + size, :n].copy()
            for j in range(1, w):
                z += every[row + j * size : row + (j + 1) * size, j : j + n]
            row += w * size
            at = np.stack([z[:, s:e].argmax(1) + s if s < e else np.full(size, -1) for s, e in zip(starts, ends, strict=True)])
            top.append(np.where(at >= 0, np.take_along_axis(z.T, np.maximum(at, 0), 0), _LOW))
            where.append(at)
        return np.concatenate(top, 1), np.concatenate(where, 1)

    def backward(self, ids: np.ndarray, where: np.ndarray, grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the filters, touched symbols, and the gradients of their embeddings."""
        if ids.ndim == 1:
            ids = ids[:, None]
        grads, symbols, parts, at = {}, [], [], 0
        for k, f in enumerate(self.filters):
            w, d, size = f.shape
            g, p = grad[:, at : at + size], where[:, at : at + size]
            at += size
            row, col = np.nonzero((g != 0) & (p >= 0))
            g, p = g[row, col], p[row, col]
            df = np.zeros((size, w, d), np.float32)
            for j in range(w):
                seen = ids[p + j]
                np.add.at(df[:, j], col, g[:, None] * self.embedding[seen].sum(1))
                back = g[:, None] * f[j].T[col]
                for h in range(seen.shape[1]):
                    symbols.append(seen[:, h])
                    parts.append(back)
            grads[f"filter{k}"] = df.transpose(1, 2, 0)
        if not symbols:
            return grads, np.empty(0, np.int64), np.empty((0, self.embedding.shape[1]), np.float32)
        symbols, inverse = np.unique(np.concatenate(symbols), return_inverse=True)
        total = np.zeros((len(symbols), self.embedding.shape[1]), np.float32)
        np.add.at(total, inverse, np.concatenate(parts))
        total[symbols == self.pad] = 0
        return grads, symbols, total


class Adagrad:
    """Per-weight step sizes; embeddings are updated only where a batch touched them."""

    def __init__(self, rate: float) -> None:
        self.rate, self.sums = rate, {}

    def update(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if name not in self.sums:
            self.sums[name] = np.full_like(value, 1e-4)
        sums = self.sums[name]
        if rows is None:
            sums += grad * grad
            value -= self.rate * grad / np.sqrt(sums)
        elif len(rows):
            sums[rows] += grad * grad
            value[rows] -= self.rate * grad / np.sqrt(sums[rows])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)
