"""Quality scores from a convolutional network over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm import _bytes as B
from brinework.llm._convnet import Adagrad, Bank, sigmoid
from brinework.llm._shared import held_out, labelled_sample

#: Chunks are two steps long and start at every step, so each byte but those of
#: the first and last step lies in two chunks; together they cover the whole text.
STEP = 256


@dataclass
class QualityModel:
    bank: Bank
    #: Filter biases, weights of the mean and of the largest chunk response, bias.
    bias: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    offset: float


def lay_out(data: np.ndarray, offsets: np.ndarray, reach: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with padding after each row, the steps' starts and ends, and each row's range of steps.

    An empty row has one step that holds one padding symbol.
    """
    sizes = np.diff(offsets)
    room = np.maximum(sizes, 1)
    base = np.concatenate([[0], np.cumsum(room + reach)])
    ids = np.full(base[-1] + reach, pad, np.int32)
    ids[np.arange(len(data)) + np.repeat(base[:-1] - offsets[:-1], sizes)] = data
    steps = -(-room // STEP)
    rows = np.concatenate([[0], np.cumsum(steps)])
    starts = np.repeat(base[:-1], steps) + (np.arange(rows[-1]) - np.repeat(rows[:-1], steps)) * STEP
    ends = np.minimum(starts + STEP, np.repeat(base[:-1] + room, steps))
    return ids, starts, ends, rows


def chunk_tops(top: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responses of the chunks (a step with the next one of its row), their steps, and each row's range of chunks."""
    steps = np.diff(rows)
    first = np.ones(len(top), bool)
    first[rows[1:][steps > 1] - 1] = False
    first = np.flatnonzero(first)
    second = np.where(np.repeat(steps, steps)[first] > 1, first + 1, first)
    counts = np.maximum(steps - 1, 1)
    return np.maximum(top[first], top[second]), np.stack([first, second], 1), np.concatenate([[0], np.cumsum(counts)])


def train(texts: list[bytes], y: list[int], *, widths: tuple[int, ...] = (2, 4, 6), per_width: int = 8, d: int = 6, epochs: int = 5, batch: int = 16, rate: float = 0.05, seed: int = 11) -> QualityModel:
    bank = Bank.random(256, d, widths, per_width, seed, pair=True)
    n, rng = bank.size, np.random.default_rng(seed)
    model = QualityModel(bank, np.zeros(n, np.float32), rng.normal(0, 0.1, n).astype(np.float32), rng.normal(0, 0.1, n).astype(np.float32), 0.0)
    y = np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        model.offset = 4.0 if len(y) and y[0] == 1 else -4.0
        return model
    offset, step = np.array([np.log(y.mean() / (1 - y.mean()))], np.float32), Adagrad(rate)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(y), batch):
            rows = order[low : low + batch]
            part = [texts[r] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            ids, starts, ends, at = lay_out(np.frombuffer(b"".join(part), np.uint8), offsets, bank.reach, bank.pad)
            top, where = bank.forward(ids, starts, ends)
            tops, steps, chunks = chunk_tops(top, at)
            act = np.maximum(tops + model.bias, 0)
            counts = np.diff(chunks)
            mean = np.add.reduceat(act, chunks[:-1], axis=0) / counts[:, None]
            most = np.maximum.reduceat(act, chunks[:-1], axis=0)
            g = ((sigmoid(mean @ model.mean + most @ model.most + offset[0]) - y[rows]) / len(rows)).astype(np.float32)
            of = np.repeat(np.arange(len(rows)), counts)
            dact = np.outer(g / counts, model.mean)[of] + np.outer(g, model.most)[of] * (act == most[of])
            dact *= act > 0
            later = np.take_along_axis(top, steps[:, 1:], 0) > np.take_along_axis(top, steps[:, :1], 0)
            dtop = np.zeros_like(top)
            np.add.at(dtop, steps[:, 0], dact * ~later)
            np.add.at(dtop, steps[:, 1], dact * later)
            grads, symbols, de = bank.backward(ids, where, dtop.astype(np.float32))
            for name, value, grad in (("mean", model.mean, mean.T @ g + 1e-4 * model.mean), ("most", model.most, most.T @ g + 1e-4 * model.most), ("bias", model.bias, dact.sum(0)), ("offset", offset, np.array([g.sum()]))):
                step.update(name, value, grad.astype(np.float32))
            for k, f in enumerate(bank.filters):
                step.update(f"filter{k}", f, grads[f"filter{k}"])
            step.update("embedding", bank.embedding, de, symbols)
    model.offset = float(offset[0])
    return model


def score_block(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ids, starts, ends, rows = lay_out(data, offsets, model.bank.reach, model.bank.pad)
    tops, _, chunks = chunk_tops(model.bank.segment_max(ids, starts, ends), rows)
    act = np.maximum(tops + model.bias, 0)
    mean = np.add.reduceat(act, chunks[:-1], axis=0) / np.diff(chunks)[:, None]
    most = np.maximum.reduceat(act, chunks[:-1], axis=0)
    return sigmoid((mean @ model.mean + most @ model.most + model.offset).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 2500, max_bytes: int = 1 << 16, modulus: int = 3, remainder: int = 1) -> QualityModel:
    """Train on at most ``max_rows`` labelled texts whose id hash is not held out."""
    learn = labels.where(~held_out("doc_id", modulus, remainder) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return train(*labelled_sample(docs, learn, "quality", max_rows, max_bytes))


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the probability that each whole text is of good quality.

    Null texts count as empty; an empty text gets the score of one empty chunk.
    Repeated rows are scored alike.  All columns of ``docs`` stay; one that bears the new name is replaced.
    """
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(batch.schema.get_field_index(text)))
            out = np.empty(batch.num_rows)
            for a, b in B.blocks(offsets):
                out[a:b] = score_block(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
