"""Language identification by a convolutional network over byte windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm import _bytes as B
from brinework.llm._convnet import Adagrad, Bank, softmax
from brinework.llm._shared import held_out, id_crc, materialize
from brinework.llm.quality import lay_out

#: Given for texts without a letter.
UNKNOWN = "und"


@dataclass
class LanguageModel:
    bank: Bank
    langs: list[str]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def train(texts: list[bytes], langs: list[str], *, widths: tuple[int, ...] = (2, 4, 6), per_width: int = 8, d: int = 6, epochs: int = 3, batch: int = 12, rate: float = 0.05, seed: int = 13) -> LanguageModel:
    """Fit the network on all fixed-length windows (256 bytes) of the texts."""
    bank, names = Bank.random(256, d, widths, per_width, seed, pair=True), sorted(set(langs))
    rng = np.random.default_rng(seed)
    model = LanguageModel(bank, names, np.zeros(bank.size, np.float32), rng.normal(0, 0.2, (bank.size, max(1, len(names)))).astype(np.float32), np.zeros(max(1, len(names)), np.float32))
    if len(names) < 2:
        return model
    y, step = np.array([names.index(x) for x in langs]), Adagrad(rate)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(y), batch):
            rows = order[low : low + batch]
            part = [texts[r] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            ids, starts, ends, at = lay_out(np.frombuffer(b"".join(part), np.uint8), offsets, bank.reach, bank.pad)
            top, where = bank.forward(ids, starts, ends)
            act = np.maximum(top + model.bias, 0)
            counts = np.diff(at)
            of = np.repeat(np.arange(len(rows)), counts)
            g = softmax(act @ model.weights + model.offset)
            g[np.arange(len(g)), y[rows][of]] -= 1
            g /= (counts[of] * len(rows))[:, None]
            dact = (g @ model.weights.T) * (act > 0)
            grads, symbols, de = bank.backward(ids, where, dact.astype(np.float32))
            for name, value, grad in (("weights", model.weights, act.T @ g + 1e-4 * model.weights), ("offset", model.offset, g.sum(0)), ("bias", model.bias, dact.sum(0))):
                step.update(name, value, grad.astype(np.float32))
            for k, f in enumerate(bank.filters):
                step.update(f"filter{k}", f, grads[f"filter{k}"])
            step.update("embedding", bank.embedding, de, symbols)
    return model


def predict_block(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and its probability, from the mean log probability of a text's windows."""
    ids, starts, ends, rows = lay_out(data, offsets, model.bank.reach, model.bank.pad)
    act = np.maximum(model.bank.segment_max(ids, starts, ends) + model.bias, 0)
    logp = np.log(softmax((act @ model.weights + model.offset).astype(np.float64)) + 1e-12)
    sizes = (ends - starts).astype(np.float64)[:, None]
    mean = np.add.reduceat(logp * sizes, rows[:-1], axis=0) / np.add.reduceat(sizes, rows[:-1], axis=0)
    p = softmax(mean)
    return p.argmax(1), p.max(1)


def fit(docs: DataFrame, *, max_rows: int = 1500, least: int = 4, max_langs: int = 1000, max_bytes: int = 1 << 14, modulus: int = 4, remainder: int = 2) -> LanguageModel:
    """Train on at most ``max_rows`` texts with a language whose id hash is not held out.

    Every language is learned: an equal share of the sample is taken of each,
    in order of a hash of the id, and ``least`` texts where that is more, so
    the sample has at most max(max_rows, least * languages) texts.  More than
    ``max_langs`` languages are an error: names so many are no languages.  Of a
    text of more than ``max_bytes`` bytes a quarter as many characters are
    learned, from a place that a hash chooses.  The bounds hold for fitting
    only.  Repeated rows count as one.
    """
    take = max_bytes // 4
    begin = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.char_length("text") - take, F.lit(1))).cast("int") + 1
    body = F.when(F.octet_length("text") > max_bytes, F.substring("text", begin, F.lit(take))).otherwise(F.col("text"))
    able = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id", modulus, remainder) & (F.octet_length("text") > 0)).select("doc_id", "lang", body.alias("text"))
    known = materialize(able.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    names = known.count()
    if names > max_langs:
        raise ValueError(f"{names} languages, more than max_langs={max_langs}")
    each = max(least, max_rows // max(1, names))
    # a first cut by the hash leaves a few times as many rows, so ordering those of a language is a small task
    mark = F.xxhash64("doc_id", "text")
    cut = F.pmod(mark, F.greatest(F.lit(1), F.floor(F.col("n") / (4 * each)))) == 0
    some = able.join(F.broadcast(known), "lang").where(cut).dropDuplicates(["doc_id", "lang", "text"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(mark, "doc_id", "text"))
    rows = some.withColumn("place", place).where(F.col("place") <= each)
    rows = rows.orderBy(id_crc("doc_id"), "doc_id", "lang", "text").select("text", "lang").toArrow()
    return train([x.encode() for x in rows.column("text").to_pylist()], rows.column("lang").to_pylist())


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its probability.

    Null texts and texts without a letter are ``und`` with score 0; of equally
    likely languages the first by name is given.  Repeated rows are predicted
    alike.  All columns stay; columns that bear the two new names are replaced.
    """
    docs = docs.drop(lang_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.langs or [UNKNOWN])
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(batch.schema.get_field_index(text)))
            best, p = np.zeros(batch.num_rows, np.int64), np.empty(batch.num_rows)
            for a, b in B.blocks(offsets):
                best[a:b], p[a:b] = predict_block(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(best)), pa.array(p)], names=[*batch.schema.names, lang_col, score_col])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({lang_col: F.when(lettered, F.col(lang_col)).otherwise(UNKNOWN), score_col: F.when(lettered, F.col(score_col)).otherwise(0.0)})
