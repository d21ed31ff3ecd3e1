"""Splitting texts into budgeted chunks, as Arrow-batched generators of parts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.functions.classify import data_category, doc_type, fiscal_year, keyword_tags
from brinework.functions.text import token_estimate

SEPARATORS = ("\n\n", "\n", " ", "")
SENTENCE_SEPARATORS = (r"(?<=[.!?])\s+", r"\n+", r"\s+", "")


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters that cover the text, cut behind the coarsest separator that works."""
    spans, stack = [], [(0, len(text), 0)]
    while stack:
        start, end, level = stack.pop()
        if end - start <= size:
            spans.append((start, end))
            continue
        while level < len(separators) - 1:
            cuts = [m.end() for m in re.finditer(separators[level], text[start:end])]
            cuts = [start + c for c in cuts if 0 < c < end - start]
            if cuts:
                break
            level += 1
        else:
            cuts = list(range(start + size, end, size))
        edges = [start, *cuts, end]
        stack.extend((a, b, level + 1 if level < len(separators) - 1 else level) for a, b in reversed(list(zip(edges[:-1], edges[1:], strict=True))))
    return spans


def split_text(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most ``size`` characters; neighbours share up to ``overlap`` characters of whole pieces.

    Without overlap the parts put together are the text again.
    """
    patterns = tuple(re.escape(s) for s in separators) if separators is SEPARATORS else separators
    pieces = _pieces(text, size, patterns)
    parts, first = [], 0
    for i in range(len(pieces)):
        if i and pieces[i][1] - pieces[first][0] > size:
            parts.append(text[pieces[first][0] : pieces[i - 1][1]])
            back = i
            while back - 1 > first and pieces[i - 1][1] - pieces[back - 1][0] <= overlap and pieces[i][1] - pieces[back - 1][0] <= size:
                back -= 1
            first = back
    if pieces:
        parts.append(text[pieces[first][0] : pieces[-1][1]])
    return parts


#: Parts of one Arrow batch that ``split_rows`` gives out.
BATCH_PARTS = 1000


def split_rows(df: DataFrame, splitter, *, text: str = "text", part: str = "part", index: str = "split_index", total: str = "total_splits") -> DataFrame:
    """One row per part of each text, with its number and the count; all other columns but the text repeat.

    ``splitter`` maps a text to its parts.  Null and empty texts give one row.
    The whole text is not repeated beside its parts: that would grow with the
    square of its length.  One text and its parts must fit a task.
    """
    rest = [f for f in df.schema.fields if f.name not in (text, part, index, total)]
    names = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField(part, T.StringType()), T.StructField(index, T.IntegerType()), T.StructField(total, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, rows = batch.select(names), ((i, *r) for i, t in enumerate(batch.column(text)) for r in _numbered_parts(t.as_py(), splitter))
            while some := list(islice(rows, BATCH_PARTS)):
                at, *columns = zip(*some, strict=True)
                made = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*others.take(pa.array(at, pa.int64())).columns, *made], names=[*names, part, index, total])

    return df.select(*[F.col(f"`{n}`") for n in names], F.col(text)).mapInArrow(run, schema)


def _numbered_parts(text: str | None, splitter) -> Iterator[tuple[str | None, int, int]]:
    parts = splitter(text) if text else [text]
    return ((p, i, len(parts)) for i, p in enumerate(parts))


def adaptive_splitter(text: str) -> list[str]:
    """Prose: texts under 200 characters stay; parts of 300 to 1000 characters, a thirtieth of the text, overlapping by 50 at most."""
    if len(text) < 200:
        return [text]
    size = max(300, min(1000, -(-len(text) // 30)))
    return split_text(text, size, min(50, size // 5))


def table_row_splitter(text: str, size: int = 300) -> list[str]:
    """Table rows: cut behind the last ', ' or '. ' of each window of ``size`` characters; nothing is lost."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = max(text.rfind(", ", at, at + size), text.rfind(". ", at, at + size))
        cut = cut + 2 if cut >= 0 else at + size
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def oversized_splitter(text: str, size: int = 3850) -> list[str]:
    """Parts of at most ``size`` characters that put together are the text."""
    return split_text(text, size)


def sentence_splitter(text: str) -> list[str]:
    """Reports: sentences first, parts of 300 characters overlapping by 50."""
    return split_text(text, 300, 50, SENTENCE_SEPARATORS)


def with_chunk_metadata(chunks: DataFrame, *, name: str = "document_name", section: str = "section_path", text: str = "text", data: str | None = None) -> DataFrame:
    """doc_type, data_category, fiscal_year, keywords and token_count of each chunk."""
    return chunks.withColumns(
        {
            "doc_type": doc_type(name),
            "data_category": data_category(section, text),
            "fiscal_year": fiscal_year(text, data),
            "keywords": keyword_tags(text, data),
            "token_count": token_estimate(text),
        }
    )


def merge_small(chunks: DataFrame, *, document: str = "doc_id", order: str = "seq", text: str = "text", keys: tuple[str, ...] = ("section_path", "chunk_type"), budget: int = 7000) -> DataFrame:
    """Neighbouring chunks of one section and kind joined while their token estimates fit ``budget``."""
    from brinework.operators.sequences import change_islands, greedy_groups

    runs = change_islands(chunks, list(keys), partition=[document], order=[order]).withColumn("_tokens", token_estimate(text))
    grouped = greedy_groups(runs, partition=[document, "island"], order=order, size="_tokens", budget=budget)
    out = grouped.groupBy(document, "island", "group").agg(F.min(order).alias(order), *[F.first(k).alias(k) for k in keys], F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_parts"), F.count("*").cast("int").alias("merged_count"))
    return out.withColumn(text, F.array_join(F.transform("_parts", lambda p: p["t"]), "\n")).drop("_parts", "island", "group")
