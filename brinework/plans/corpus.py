"""Filing documents to chunks, as one lazy plan without a shuffle: each document is one row from the start.

A document, its blocks and its chunks must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.functions.dates import iso_dates, may_have_dates
from brinework.functions.text import contents_removed, may_have_contents, path_simplified, special_chars_removed, unmarked
from brinework.operators.blocks import document_blocks, merged, numbered
from brinework.operators.chunking import adaptive_splitter, with_chunk_metadata
from brinework.operators.narration import narrated

_MAP = pa.map_(pa.string(), pa.string())
_BLOCK = pa.schema([("doc_id", pa.string()), ("seq", pa.int32()), ("section_path", pa.string()), ("chunk_type", pa.string()), ("text", pa.string()), ("structured_data", _MAP), ("_data", _MAP), ("unit", pa.string())])
_CHUNK = pa.schema([("doc_id", pa.string()), ("seq", pa.int64()), ("section_path", pa.string()), ("chunk_type", pa.string()), ("text", pa.string()), ("chunk_id", pa.string()), ("prev_context", pa.string()), ("next_context", pa.string())])


#: Rows of one Arrow batch that a fold gives out.
BATCH_ROWS = 1000


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some ``BATCH_ROWS`` rows each."""
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, body in zip(*batch.columns, strict=True):
                for seq, path, kind, text, data, told, unit in document_blocks(body.as_py() or ""):
                    yield doc_id.as_py(), seq, path, kind, text, data and [*data.items()], told and [*told.items()], unit

    yield from _batches(rows(), _BLOCK)


def _told(documents: DataFrame) -> DataFrame:
    """The blocks of :func:`parse`, and those without a text."""
    kinds = "doc_id string, seq int, section_path string, chunk_type string, text string, structured_data map<string,string>, _data map<string,string>, unit string"
    rows = documents.select(F.col("doc_id").cast("string"), "body").mapInArrow(_parsed, kinds)
    told = F.when(F.col("chunk_type") == "table_row", narrated("section_path", "_data"))
    return rows.withColumn("text", F.coalesce("text", told)).drop("_data")


def parse(documents: DataFrame) -> DataFrame:
    """Blocks of (doc_id, body) Markdown documents: doc_id, seq, section_path, chunk_type, text, structured_data, unit.

    See :func:`brinework.operators.blocks.document_blocks`.  A table row's text is
    a sentence by its section and keys, with numbers in the table's unit of
    money written out.  A null body has no blocks.  Document ids are distinct.
    """
    return _told(documents).where("text is not null")


def _plain(blocks: DataFrame) -> DataFrame:
    """The blocks of :func:`normalise`, and those that end up empty; a text goes through a step's patterns only if it holds what they need.

    No filter on the text may follow before the next fold: moved before these steps it would repeat each for every mention of the text.
    """
    text = F.col("text")
    for may, step in (
        (may_have_contents(text), contents_removed),
        (F.contains(text, F.lit("*")), unmarked),
        (F.contains(text, F.lit(">")), path_simplified),
        (may_have_dates(text), iso_dates),
    ):
        blocks = blocks.withColumn("text", F.when(may, step(text)).otherwise(text))
    return blocks.withColumn("text", special_chars_removed(text))


def normalise(blocks: DataFrame) -> DataFrame:
    """Tables of contents, marks, dates and special characters put in order; blocks that end up empty drop out."""
    return blocks.withColumn("text", special_chars_removed(iso_dates(path_simplified(unmarked(contents_removed("text")))))).where("text <> ''")


def _assembled(budget: int, merge: bool):
    extra = [("merged_count", pa.int32())] if merge else [("split_index", pa.int32()), ("total_splits", pa.int32())]
    schema = pa.schema([*_CHUNK, *extra])

    def document(blocks: list[tuple]) -> Iterator[tuple]:
        parts = []
        for doc_id, seq, path, kind, text in blocks:
            split = adaptive_splitter(text)
            parts += [{"doc_id": doc_id, "seq": seq * 100_000 + i, "section_path": path, "chunk_type": kind, "text": t, "tokens": len(t) // 4, "split_index": i, "total_splits": len(split)} for i, t in enumerate(split)]
        for r in numbered(blocks[0][0], merged(parts, budget) if merge else parts):
            yield tuple(r[f.name] for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns, strict=True) if row[4].as_py())
        yield from _batches(chain.from_iterable(document(list(some)) for _, some in groupby(blocks, key=itemgetter(0))), schema)

    return run


def _chunked(blocks: DataFrame, *, budget: int, merge: bool) -> DataFrame:
    """Chunks of blocks that stand document by document, in order, in their partitions; blocks without text are passed over."""
    kinds = "doc_id string, seq long, section_path string, chunk_type string, text string, chunk_id string, prev_context string, next_context string, " + ("merged_count int" if merge else "split_index int, total_splits int")
    out = blocks.select("doc_id", "seq", "section_path", "chunk_type", "text").mapInArrow(_assembled(budget, merge), kinds)
    return with_chunk_metadata(out.withColumn("document_name", F.col("section_path")))


def chunk(blocks: DataFrame, *, budget: int = 7000, merge: bool = True) -> DataFrame:
    """Split, merged, numbered chunks with context and metadata.

    Chunks are put in order by line and part; ``seq`` is a long, 100,000 times
    the line plus the part.  The blocks are dealt to tasks by document.
    """
    return _chunked(blocks.repartition("doc_id").sortWithinPartitions("doc_id", "seq"), budget=budget, merge=merge)


def build(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, body) to chunks.

    Blocks without text drop out in the last fold: Spark would move a filter on
    the text before the steps that make it, and take each of them twice.
    """
    return _chunked(_plain(_told(documents)), budget=7000, merge=True)
