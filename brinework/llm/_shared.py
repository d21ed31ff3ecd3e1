"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that may clash with columns of the caller are prefixed with this.
PREFIX = "_bw_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting and without a checkpoint
    directory (as in tests) gets a temporary folder; on a cluster the setting
    must be there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="brinework-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Folders of intermediate tables, innermost :func:`scratch` last; each thread has its own.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that this thread writes inside are deleted at the end; write what is to stay before."""
    path = f"{shared_dir(spark)}/brinework/scratch-{uuid.uuid4().hex}"
    token = _scratch.set((*_scratch.get(), path))
    try:
        yield path
    finally:
        _scratch.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back; ``codec`` compresses it, else the session's does.

    Cuts the lineage: a lost executor only costs a new read of these files.
    They stay until the enclosing :func:`scratch` ends, or for good without one.
    """
    spark = df.sparkSession
    folder = _scratch.get()[-1] if _scratch.get() else f"{shared_dir(spark)}/brinework"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as a long; ids of another type are refused, since results are ordered by id as a number."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")
    return F.col(name).cast("long")


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` with ``name``, each row's place (from 1) in the order of all rows.

    The rows are sorted in ranges and written; the number of rows in each range
    (one number a range) passes through the driver, so no task sees all rows.
    """
    at, part = PREFIX + "at", PREFIX + "part"
    rows = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    ahead, total = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part).count().collect()):
        ahead.append((p, total))
        total += n
    bases = df.sparkSession.createDataFrame(ahead, f"`{part}` long, `{PREFIX}base` long")
    place = F.col(PREFIX + "base") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(bases), part).withColumn(name, place).drop(at, part, PREFIX + "base")


def grown(rows: int, least: int, each: int) -> int:
    """A number of parts that grows with the rows: about ``each`` rows a part, ``least`` parts at least."""
    return max(least, -(-rows // each))


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True for rows whose id hash leaves ``remainder``; never learned from."""
    return id_crc(doc_id) % modulus == remainder


def text_or_empty(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit(""))


def hash_sample(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows in order of a hash of ``keys``, the same on every run.

    A first cut by the hash leaves about twice as many rows, so the task that
    orders them does not grow with the table.
    """
    share = max(1, df.count() // (2 * max(1, max_rows)))
    mark = F.xxhash64(*keys)
    return df.where(F.pmod(mark, F.lit(share)) == 0).orderBy(mark, *keys).limit(max_rows)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, *more: str) -> DataFrame:
    """At most ``max_rows`` texts (bytes) of at most ``max_bytes`` bytes, their label, and ``more`` columns, in one partition.

    Rows are taken in order of a hash of the id, so the sample is the same on
    every run.  ``labels`` holds ``doc_id`` and ``label``; of repeated ids the
    largest label counts.  Both bounds hold for fitting only: scoring reads
    every text whole.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_bw_y"))
    ids = hash_sample(ids, ["doc_id"], max_rows)
    rows = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", F.col("text").cast("binary").alias("_bw_text"), *more)
    rows = rows.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_bw_text").limit(max_rows)
    return rows.select("_bw_text", "_bw_y", *more)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, *more: str) -> tuple[list, ...]:
    """The columns of :func:`labelled_rows` as lists."""
    return tuple(c.to_pylist() for c in labelled_rows(docs, labels, label, max_rows, max_bytes, *more).toArrow().columns)
