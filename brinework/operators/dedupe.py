"""Keep-first, keep-latest, upsert, delete and pending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order``; end the order with a unique column for a stable choice."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` values of each key, by a map-side combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(df.columns)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``existing`` and the first incoming row of each key that it lacks."""
    fresh = keep_first(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: of both tables the row with the largest ``order`` stays, incoming first on a tie."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return keep_latest(both, keys, [*order, "_side"]).drop("_side")


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_cascade(parents: DataFrame, gone: DataFrame, keys: list[str], *dependents: DataFrame) -> tuple[DataFrame, ...]:
    """The table and its dependents, which carry its keys, without the rows whose keys are listed; rows with null keys stay."""
    return tuple(delete_keys(t, gone, keys) for t in (parents, *dependents))


def pending(rows: DataFrame, done: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows whose key is not among the done ones."""
    return rows.join(done.select(F.col(right_key).alias(left_key)), left_key, "left_anti")


def only_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(listed.select(key).distinct(), key, "left_semi")
