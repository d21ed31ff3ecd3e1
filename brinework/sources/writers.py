"""Writers of chunks, reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.session import working_folder


def jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def csv(df: DataFrame, path: str, *, separator: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=separator, escape='"', encoding="UTF-8")


def partitioned(df: DataFrame, path: str, by: list[str], *, compression: str = "zstd") -> None:
    """Parquet folders by column, rows of one folder written together."""
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode("overwrite").partitionBy(*by).option("compression", compression).parquet(path)


def truncate(spark, path: str, *dependents: str) -> None:
    """An empty table of the same schema; tables that depend on it are emptied first."""
    for p in (*dependents, path):
        spark.createDataFrame([], spark.read.parquet(p).schema).write.mode("overwrite").parquet(p)


def evaluations(rows: DataFrame, path: str, *, run: str) -> None:
    """Evaluation rows of one run, in a folder of their own; writing a run again replaces it."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def table_info(spark, names: list[str]) -> DataFrame:
    """(table, exists, rows) of catalog tables."""
    rows = [(n, spark.catalog.tableExists(n)) for n in names]
    return spark.createDataFrame([(n, e, spark.table(n).count() if e else 0) for n, e in rows], "table string, exists boolean, rows long")


def comparison(results: DataFrame, *, query_id: str = "query_id", model: str = "model", value: str = "similarity", most: int = 1000) -> DataFrame:
    """One row per query with a column per model; more than ``most`` models are an error, since columns are named on the driver.

    The results are worked out once and written to the shared folder, from which models and values are read.
    """
    path = working_folder(results.sparkSession, "comparison")
    results = results.select(query_id, model, value)
    results.write.parquet(path)
    results = results.sparkSession.read.schema(results.schema).parquet(path)
    models = [r[0] for r in results.select(model).distinct().orderBy(model).limit(most + 1).collect()]
    if len(models) > most:
        raise ValueError(f"more than {most} models: keep the results in rows, or raise most")
    return results.groupBy(query_id).pivot(model, models).agg(F.first(value))
