"""Metadata of any shape as VARIANT, with its frequent paths as columns of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, json: str, *, name: str = "meta") -> DataFrame:
    """``df`` with the JSON column parsed once into a VARIANT column; text that is no JSON gives null."""
    return df.withColumn(name, F.try_parse_json(json))


def at(path: str, kind: str, *, name: str = "meta") -> Column:
    """The value at a path such as ``$.a.b[0]``, null where it lacks or is of another kind."""
    return F.try_variant_get(name, path, kind)


def write(df: DataFrame, path: str, *, json: str, columns: dict[str, tuple[str, str]], by: str, name: str = "meta") -> None:
    """A Parquet table with the VARIANT column and a typed column for each frequent path, sorted by one of them.

    columns: name of the column -> (path, type).  Conditions on such a column
    reach the Parquet scan, and, as the rows are sorted, skip its row groups.
    """
    out = parsed(df, json, name=name).drop(json)
    out = out.withColumns({c: at(p, kind, name=name) for c, (p, kind) in columns.items()})
    out.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def paths(df: DataFrame, *, name: str = "meta", key: str) -> DataFrame:
    """(path, kind, rows): every path at the top of the documents, the kind of its value, and how many rows have it."""
    found = df.select(key, name).lateralJoin(df.sparkSession.tvf.variant_explode(F.col(name).outer())) if hasattr(df.sparkSession, "tvf") else None
    return found.select(F.concat(F.lit("$."), F.col("key")).alias("path"), F.schema_of_variant("value").alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("rows"))
