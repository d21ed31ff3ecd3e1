"""Exact duplicates by a tree-merge of sorted digest runs.

A run is a sorted list of (digest, length, smallest id, largest id, rows).  It
travels as segments: rows that each hold a few hundred neighbouring entries of
one slice of the digest range.  In a binomial round, runs whose numbers differ
in some bits meet and each keeps the slices whose number has its own bits, so
after the last round run k holds slice k of all rows; nothing ever meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm._shared import PREFIX, grown, integer_id, materialize

KEY, SIZE, RUN, ID, LOW, HIGH, COUNT, GROUP = (PREFIX + x for x in ("key", "bytes", "run", "id", "low", "high", "count", "group"))

#: Runs at least, and rows of a run beyond which there are more runs.
RUNS, RUN_ROWS = 16, 1_000_000
#: Entries of a segment at most.
SEGMENT = 256
_NONE_LOW, _NONE_HIGH = 2**63 - 1, -(2**63)


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def run_of(runs: int) -> Column:
    """The run of a row: its partition, so rows of one text or one id lie in many runs.  Write it before it is used twice."""
    return F.pmod(F.spark_partition_id(), F.lit(runs)).cast("long")


def digests(docs: DataFrame, *, text: str = "text", key: str = KEY, size: str = SIZE) -> DataFrame:
    """``docs`` without the text, with the SHA-256 of each whole text, A-Z lower-cased, and its length in bytes."""
    keep = [c for c in docs.columns if c not in (text, key, size)]
    schema = docs.select(*keep, F.lit(b"").alias(key), F.lit(0).cast("long").alias(size)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = pc.ascii_lower(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null(""))
            _, offsets, data = col.buffers()
            at, data = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1], memoryview(data or b"")
            keys = pa.array([hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), keys, pa.array(np.diff(at))], schema=pa.schema([*(batch.schema.field(c) for c in keep), (key, pa.binary()), (size, pa.int64())]))

    return docs.select(*keep, text).mapInArrow(run, schema)


_SEGMENTS = f"`{RUN}` long, slot long, first binary, entries binary, low array<long>, high array<long>, count array<long>"
_FLAT = f"`{RUN}` long, `{KEY}` binary, `{SIZE}` long, `{LOW}` long, `{HIGH}` long, `{COUNT}` long"


class _Entries:
    """Sorted entries of one or more runs: names (digest and length as bytes), ids and counts."""

    def __init__(self, names: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        self.names, self.low, self.high, self.count = names, low, high, count

    def __len__(self) -> int:
        return len(self.names)

    def part(self, a: int, b: int) -> _Entries:
        return _Entries(self.names[a:b], self.low[a:b], self.high[a:b], self.count[a:b])

    @staticmethod
    def joined(parts: list[_Entries]) -> _Entries:
        return _Entries(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("names", "low", "high", "count")))

    def merged(self) -> _Entries:
        """One entry a name.  The stable sort merges the runs that it finds in order."""
        order = np.argsort(self.names, kind="stable")
        names = self.names[order]
        new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.empty(0, np.int64)
        if not len(new):
            return self
        return _Entries(names[new], np.minimum.reduceat(self.low[order], new), np.maximum.reduceat(self.high[order], new), np.add.reduceat(self.count[order], new))

    def slots(self, bits: int) -> np.ndarray:
        head = np.frombuffer(self.names.tobytes(), np.uint8).reshape(len(self), -1)[:, :4].astype(np.int64)
        return ((head[:, 0] << 24) | (head[:, 1] << 16) | (head[:, 2] << 8) | head[:, 3]) >> (32 - bits)

    def segments(self, run: int, bits: int) -> pa.RecordBatch:
        """Rows of at most SEGMENT entries that each lie in one slice of the digest range."""
        slots, width = self.slots(bits), self.names.dtype.itemsize
        new = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        ends = np.append(new[1:], len(slots))
        cuts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(new.tolist(), ends.tolist(), strict=True)])
        edges = np.append(cuts, len(slots)).astype(np.int32)
        blob = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(edges * np.int32(width)), pa.py_buffer(self.names.tobytes())])
        firsts = pa.array([self.names[i : i + 1].tobytes() for i in cuts.tolist()], pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (self.low, self.high, self.count)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), run)), pa.array(slots[cuts]), firsts, blob, *lists], names=[RUN, "slot", "first", "entries", "low", "high", "count"])

    def flat(self, run: int) -> pa.RecordBatch:
        n, width = len(self), self.names.dtype.itemsize
        raw = np.frombuffer(self.names.tobytes(), np.uint8).reshape(n, width)
        keys = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width - 8)), pa.py_buffer(np.ascontiguousarray(raw[:, :-8]))])
        sizes = np.ascontiguousarray(raw[:, -8:]).view(">i8").ravel().astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, run)), keys, pa.array(sizes), pa.array(self.low), pa.array(self.high), pa.array(self.count)], names=[RUN, KEY, SIZE, LOW, HIGH, COUNT])


def _names(keys: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Digest and big-endian length of each row as one fixed-width byte string; compares like the pair."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(len(keys), -1)
    both = np.concatenate([raw, sizes.astype(">i8").view(np.uint8).reshape(len(sizes), 8)], 1)
    return np.ascontiguousarray(both).view(f"S{both.shape[1]}").ravel()


def _leaves(bits: int):
    """Rows sorted by (run, key, bytes) to the segments of one run for each run; one entry stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            runs, low, high = cols[RUN].to_numpy(), cols[LOW].to_numpy(), cols[HIGH].to_numpy()
            all_rows = _Entries(_names(cols[KEY], cols[SIZE].to_numpy()), low, high, np.ones(len(low), np.int64))
            cuts = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1, [len(runs)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = all_rows.part(a, b)
                if number == runs[a]:
                    part = _Entries.joined([held, part])
                elif held is not None:
                    yield held.segments(number, bits)
                number, part = int(runs[a]), part.merged()
                if len(part) > 1:
                    yield part.part(0, len(part) - 1).segments(number, bits)
                held = part.part(len(part) - 1, len(part))
        if held is not None:
            yield held.segments(number, bits)

    return run


def _unpacked(batch: pa.RecordBatch, a: int, b: int) -> _Entries:
    cols = {c: batch.column(i).slice(a, b - a) for i, c in enumerate(batch.schema.names)}
    blob = b"".join(cols["entries"].to_pylist())
    low, high, count = (cols[c].flatten().to_numpy() for c in ("low", "high", "count"))
    return _Entries(np.frombuffer(blob, f"S{len(blob) // len(low)}"), low, high, count)


def _merge(bits: int, flat: bool):
    """Multiway merge of the runs that met: segments come sorted by (run, slice, first entry).

    All entries below the first entry of the segment at hand are final, so
    only as much as the runs overlap is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pool = None, None

        def give(entries: _Entries, number: int) -> pa.RecordBatch:
            return entries.flat(number) if flat else entries.segments(number, bits)

        for batch in batches:
            if not batch.num_rows:
                continue
            runs, slots = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (RUN, "slot"))
            firsts = batch.column(batch.schema.get_field_index("first"))
            change = np.flatnonzero((runs[1:] != runs[:-1]) | (slots[1:] != slots[:-1])) + 1
            cuts = np.unique(np.concatenate([[0], change, np.arange(0, len(runs), 512), [len(runs)]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = (int(runs[a]), int(slots[a]))
                part = _unpacked(batch, a, b)
                if here == group:
                    part = _Entries.joined([pool, part])
                elif pool is not None:
                    yield give(pool, group[0])
                group, part = here, part.merged()
                done = int(np.searchsorted(part.names, np.frombuffer(firsts[b - 1].as_py(), part.names.dtype)[0]))
                if done:
                    yield give(part.part(0, done), group[0])
                pool = part.part(done, len(part))
        if pool is not None:
            yield give(pool, group[0])

    return run


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column(batch.schema.get_field_index(RUN)).to_numpy()
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1, np.arange(0, len(runs), 512), [len(runs)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield _unpacked(batch, a, b).flat(int(runs[a]))


def resolve(rows: DataFrame, *, runs: int = RUNS, fan_in: int = 4) -> DataFrame:
    """Merge (RUN, KEY, SIZE, ID) rows into groups, answered once for each (RUN, KEY).

    Keys are all of one length, four bytes or more.  A run is pre-merged before
    anything moves, so a digest that a third of all rows share leaves each run
    as one entry.  log2(runs) / log2(fan_in) binomial rounds follow, in each of
    which ``fan_in`` runs exchange their slices; both numbers are powers of two.
    Returns (RUN, KEY, SIZE, LOW, HIGH, COUNT, GROUP): smallest and largest id,
    number of rows, and a number of the whole group.  Without any id LOW is the
    largest long and HIGH the smallest.
    """
    if runs != power_of_two(runs) or fan_in != power_of_two(fan_in) or fan_in < 2:
        raise ValueError("runs and fan_in must be powers of two")
    bits, step = runs.bit_length() - 1, fan_in.bit_length() - 1
    leaf = rows.select(F.col(RUN), KEY, SIZE, F.coalesce(F.col(ID), F.lit(_NONE_LOW)).alias(LOW), F.coalesce(F.col(ID), F.lit(_NONE_HIGH)).alias(HIGH))
    leaf = leaf.repartitionById(runs, F.col(RUN).cast("int")).sortWithinPartitions(RUN, KEY, SIZE)
    leaf = materialize(leaf.mapInArrow(_leaves(bits), _SEGMENTS), "runs")
    top, left = leaf, bits
    while True:
        mask = (1 << left) - (1 << max(0, left - step))
        left = max(0, left - step)
        target = F.col(RUN).bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("slot").bitwiseAND(F.lit(mask)))
        met = top.withColumn(RUN, target).repartitionById(runs, target.cast("int")).sortWithinPartitions(RUN, "slot", "first")
        top = met.mapInArrow(_merge(bits, left == 0), _FLAT if left == 0 else _SEGMENTS)
        if left == 0:
            break
    top = materialize(top.drop(RUN).withColumn(GROUP, F.monotonically_increasing_id()), "groups")
    return leaf.mapInArrow(_flatten, _FLAT).select(RUN, KEY, SIZE).join(top, [KEY, SIZE])


def smallest(low: str = LOW, high: str = HIGH) -> Column:
    """The smallest id of a group, null if none of its rows has one."""
    return F.when(F.col(high) != _NONE_HIGH, F.col(low))


def exact_dedup(docs: DataFrame, *, keep: str = "min", doc_id: str = "doc_id", text: str = "text", runs: int | None = None, fan_in: int = 4) -> DataFrame:
    """For every row: the row that stays of its group of equal texts.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty.  Each group is verified by SHA-256 and byte length at every level.
    keep: ``min`` or ``max``, the smallest or largest id stays.  Ids are
    integers, others are refused.  Null ids are never the one that stays unless
    a group has no other; repeated rows with the id that stays are all marked
    as kept.  Returns doc_id, keep_id, group_size, kept, text_sha256, n_bytes;
    an empty table gives no rows.

    Partitions sort their digests into runs, which are merged in binomial
    rounds (see :func:`resolve`).  The number of runs grows with the rows
    unless it is given.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep!r}")
    runs = runs or power_of_two(grown(docs.count(), RUNS, RUN_ROWS))
    read = digests(docs.select(integer_id(docs, doc_id).alias(ID), F.col(text).alias("text")))
    rows = materialize(read.withColumn(RUN, run_of(runs)), "digests")
    groups = resolve(rows, runs=runs, fan_in=fan_in)
    best = F.when(F.col(HIGH) != _NONE_HIGH, F.col(LOW if keep == "min" else HIGH))
    out = rows.join(groups, [RUN, KEY, SIZE]).withColumn("keep_id", best)
    return out.select(F.col(ID).alias("doc_id"), "keep_id", F.col(COUNT).alias("group_size"), F.col(ID).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(KEY)).alias("text_sha256"), F.col(SIZE).alias("n_bytes"))
