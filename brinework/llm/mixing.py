"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm._bytes import mix
from brinework.llm._shared import PREFIX, grown, integer_id, materialize

WORDS = r"[^\x20\x09-\x0D]+"
ID, SOURCE, SIZE, MASS, COPIES, UNIT, LEVEL = (PREFIX + x for x in ("id", "source", "size", "mass", "copies", "unit", "level"))


def row_key(doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    """A hash of the row; only rows that agree in all three columns share one, but for chance."""
    return F.xxhash64(F.col(doc_id), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.col(source))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(SOURCE, source_size) rows with each source's target.

    Sources take the weights in turn, in code-point order with null last.  The
    targets share ``share`` of all sizes by weight; a target stops at ``most``
    times its source and the excess goes to the others by weight, until none is
    above.  Only sums reach the driver, however many sources there are.
    """
    spark = sizes.sparkSession
    placed = materialize(sizes.orderBy(F.col(SOURCE).asc_nulls_last()).withColumn(UNIT, F.monotonically_increasing_id()), "sources")
    part = F.shiftright(F.col(UNIT), 33)
    counts = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    ahead, total = {}, 0
    for p, n in sorted((r.p, r.n) for r in counts):
        ahead[p] = total
        total += n
    bases = spark.createDataFrame(list(ahead.items()), "p long, base long")
    rank = F.col("base") + F.col(UNIT).bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("p", part).join(F.broadcast(bases), "p").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    placed = materialize(placed.select(SOURCE, "source_size", "weight"), "weights")
    wanted = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level, last = 0.0, -1
    while True:
        capped = F.col("weight") * level >= most * F.col("source_size")
        row = placed.agg(F.sum(F.when(capped, most * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if row[2] == last or not row[1]:
            break
        last, level = row[2], (wanted - (row[0] or 0.0)) / row[1]
    return placed.select(SOURCE, "source_size", F.least(F.col("weight") * level, most * F.col("source_size")).alias("target"))


def _uniform(seed: int, keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that the key, the level and the seed fix."""
    h = mix(keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((seed * 1000003 + step) & (2**63 - 1)))
    return (h >> np.uint64(11)).astype(np.float64) / 2**53


def _pivot(seed: int, step: int, last: bool):
    """Pair open rows within each (unit, source); at most one stays open.

    A row's mass is the expected number of words of its extra copy, between 0
    and its size.  Of two open rows one gives, the other takes, until one mass
    is 0 or its size; which way is drawn so that expectations stay, and the sum
    of the masses stays exactly.  Rows come sorted by unit and source, so one
    open row is all that is held.  The last level draws for the remaining row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = object(), None
        rows: list[tuple] = []

        def close(row: tuple, mass: float) -> None:
            rows.append((row[0], row[1], row[2], row[3], mass, mass > 0, -1))

        def leave(row: tuple, mass: float, u: float) -> None:
            if last:
                close(row, row[3] if u * row[3] < mass else 0.0)
            else:
                rows.append((row[0], row[1], row[2], row[3], mass, False, row[4] + 1))

        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            units, sources, ids, sizes, masses, levels = (cols[c].to_pylist() for c in (UNIT, SOURCE, ID, SIZE, MASS, LEVEL))
            keys = cols[PREFIX + "key"].to_numpy()
            draws = _uniform(seed, keys, 2 * step)
            for unit, source, i, size, mass, level, key, u in zip(units, sources, ids, sizes, masses, levels, keys.tolist(), draws.tolist(), strict=True):
                if (unit, source) != group:
                    if held is not None:
                        leave(*held)
                    group, held = (unit, source), None
                row = (i, source, key, size, level)
                tiny = 1e-9 * size
                if mass <= tiny or mass >= size - tiny:
                    close(row, size if mass > tiny else 0.0)
                    continue
                if held is None:
                    held = (row, mass, u)
                    continue
                other, had, drawn = held
                up, down = min(size - mass, had), min(mass, other[3] - had)
                if u * (up + down) < down:
                    mass, had = mass + up, had - up
                else:
                    mass, had = mass - down, had + down
                mine = mass <= tiny or mass >= size - tiny
                slack = 1e-9 * other[3]
                theirs = had <= slack or had >= other[3] - slack
                if mine:
                    close(row, size if mass > tiny else 0.0)
                if theirs:
                    close(other, other[3] if had > slack else 0.0)
                held = None if mine and theirs else (other, had, drawn) if mine else (row, mass, u)
            if len(rows) >= 10_000:
                yield _rows(rows)
                rows.clear()
        if held is not None:
            leave(*held)
        if rows:
            yield _rows(rows)

    return run


_SCHEMA = f"`{ID}` long, `{SOURCE}` string, `{PREFIX}key` long, `{SIZE}` long, `{MASS}` double, `{COPIES}` boolean, `{LEVEL}` int"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[ID, SOURCE, PREFIX + "key", SIZE, MASS, COPIES, LEVEL])


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 20, units: int | None = None, fan_in: int = 32, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many copies of each document the mix takes.

    Returns doc_id, source, size (words, null text: 0), source_size, target
    (of the source), copies, taken (copies * size) and :func:`row_key`.  Every document has the
    same expected number of words per word of its source; a document is taken
    floor or ceiling of target / source_size times, so at most ``most`` times.
    The taken words of a source differ from its target by less than one
    document.  Null sources form a source of their own; documents without words
    are taken 0 times; repeated rows are rounded each on its own; reruns agree.
    Ids are integers.

    The rows are dealt over ``units`` by a hash of the id and rounded there in
    one pass that holds one open row for each source.  Longer documents come
    first, so the row that is drawn in the end is a short one.  The open rows (at
    most units x sources) are combined ``fan_in`` units at a time, level by level.
    There are 512 units, and more from half a million rows a unit on.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(integer_id(docs, doc_id).alias(ID), F.col(source).cast("string").alias(SOURCE), row_key(doc_id, text, source).alias(PREFIX + "key"), size.alias(SIZE))
    rows = materialize(rows, "sizes")
    units = units or grown(rows.count(), 512, 500_000)
    targets = materialize(source_targets(rows.groupBy(SOURCE).agg(F.sum(SIZE).alias("source_size")), weights, share, most), "targets")
    few = targets.count() <= 100_000
    dim = F.broadcast(targets) if few else targets
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.join(dim.withColumnRenamed(SOURCE, PREFIX + "s"), F.col(SOURCE).eqNullSafe(F.col(PREFIX + "s")))
    joined = joined.select(ID, SOURCE, PREFIX + "key", SIZE, (F.col(SIZE) * (rate - F.floor(rate))).alias(MASS), F.lit(0).alias(LEVEL), F.pmod(F.col(PREFIX + "key"), F.lit(units)).alias(UNIT))
    done, open_rows, step, left = None, joined, 0, units
    while True:
        last = left == 1
        dealt = (open_rows.repartition(UNIT, SOURCE) if step else open_rows.repartition(-(-units // 2), UNIT)).sortWithinPartitions(UNIT, SOURCE, F.desc(SIZE), PREFIX + "key", ID)
        level = materialize(dealt.mapInArrow(_pivot(seed, step, last), _SCHEMA), f"level{step}")
        closed = level.where(F.col(LEVEL) == -1)
        done = closed if done is None else done.unionAll(closed)
        if last:
            break
        step, left = step + 1, -(-left // fan_in)
        open_rows = level.where(F.col(LEVEL) != -1).select(ID, SOURCE, PREFIX + "key", SIZE, MASS, LEVEL, F.pmod(F.xxhash64(PREFIX + "key"), F.lit(left)).alias(UNIT))
    out = done.join(dim.withColumnRenamed(SOURCE, PREFIX + "s"), F.col(SOURCE).eqNullSafe(F.col(PREFIX + "s")))
    copies = F.when(F.col(SIZE) == 0, 0).otherwise(F.floor(rate) + F.col(COPIES).cast("int")).cast("long")
    return out.select(F.col(ID).alias("doc_id"), F.col(SOURCE).alias("source"), F.col(SIZE).alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col(SIZE)).alias("taken"), F.col(PREFIX + "key").alias("row_key"))
