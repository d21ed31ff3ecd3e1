"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Only DataFrame functions are used.  A row's number is its place among all rows
in the order of (bucket of its id, id, text hash, size); a Feistel network over
the numbers 0..rows-1, with cycle walking, gives its place in the shuffle.  Shard
and slot follow from that place by arithmetic, so they can be computed for any
row number without the data (see :func:`place`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm._shared import PREFIX, grown

ROUNDS = 6


def domain(rows: int, tries: int = 4096) -> tuple[int, int]:
    """Two factors whose product is at least ``rows``, and hardly more.

    At most ``a * b - rows`` numbers lie outside, so a walk ends after as many
    steps; among ``tries`` pairs the one with the fewest is taken.
    """
    root = max(1, math.isqrt(max(0, rows - 1)) + 1)
    pairs = ((a, -(-max(rows, 1) // a)) for a in range(root, root + max(1, min(tries, root))))
    return min(pairs, key=lambda p: (p[0] * p[1] - rows, p[0]))


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of ``number`` (0..rows-1) in a shuffle of 0..rows-1 that ``seed`` fixes."""
    a, b = domain(rows)

    def step(state: Column, k: Column) -> Column:
        size = F.when(k % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        other = F.pmod(F.xxhash64(state["y"], k, F.lit(seed)), size)
        return F.struct(state["y"].alias("x"), ((state["x"] + other) % size).alias("y"))

    def feistel(n: Column) -> Column:
        start = F.struct(F.floor(n / F.lit(b)).cast("long").alias("x"), (n % b).cast("long").alias("y"))
        return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, step, lambda s: s["x"] * b + s["y"])

    outside = a * b - rows
    first = feistel(number)
    if outside <= 0:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(outside)), first, lambda acc, _: F.when(acc >= rows, feistel(acc)).otherwise(acc))


def place(number: Column, rows: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """Shard and slot of a row number: shard counts differ by one at most, slots have no gaps."""
    at = permuted(number, rows, seed)
    return (at % shards).cast("int"), F.floor(at / shards).cast("long")


def shard(docs: DataFrame, shards: int = 40, *, seed: int = 0, buckets: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``row_number``, ``shard`` and ``slot``.

    Row numbers depend on the rows alone, not on how they are partitioned.
    Rows that agree in id, text and size may swap numbers with each other; a
    null id or text sorts first.  An empty table gives an empty result.  Other
    columns stay; those that bear one of the new names are replaced.

    The rows are shuffled once, by the hash of the id (and of the text where
    ids repeat).  Only the ``buckets`` counts meet in one task: 4096, and more
    from a million rows a bucket on.
    """
    docs = docs.drop("row_number", "shard", "slot")
    key, base, number, crc = (PREFIX + x for x in ("bucket", "base", "n", "crc"))
    rows = docs.count()
    buckets = buckets or grown(rows, 4096, 1_000_000)
    bucket = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(buckets)).cast("int")
    sizes = docs.select(bucket.alias(key)).groupBy(key).agg(F.count("*").alias(number))
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(base))
    order = Window.partitionBy(key).orderBy(doc_id, crc, *[F.hash(F.col(f"`{c}`").cast("string")) for c in docs.columns if c not in (doc_id, text)])
    out = docs.withColumns({key: bucket, crc: F.xxhash64(text)}).withColumn(number, F.row_number().over(order) - 1)
    out = out.join(F.broadcast(bases), key).withColumn("row_number", F.col(base) + F.col(number))
    at_shard, slot = place(F.col("row_number"), max(rows, 1), shards, seed)
    return out.drop(key, base, number, crc).withColumns({"shard": at_shard, "slot": slot})
