"""Statistics of a run, counted while its rows are written."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATISTICS = "run string, rows long, succeeded long, failed long, seconds double"


def write_observed(df: DataFrame, path: str, statistics: str, *, run: str, valid: Column, write: Callable[[DataFrame], None] | None = None, only_valid: bool = True) -> dict:
    """Writes the valid rows of ``df`` to ``path`` and a row of statistics to ``statistics``; returns the statistics.

    Rows, valid and other ones (a null verdict counts as invalid) are counted by
    the job that writes them, without a second pass.  Each run has a folder of
    its own in both tables; a run that is repeated replaces itself.  ``write``
    takes over the writing of the rows.
    """
    good = F.coalesce(valid, F.lit(False))
    seen = Observation(f"run {run}")
    rows = df.withColumn("_valid", good).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_valid")).alias("succeeded"), F.count_if(~F.col("_valid")).alias("failed"))
    rows = (rows.where("_valid") if only_valid else rows).drop("_valid")
    began = time.time()
    if write is None:
        rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    else:
        write(rows)
    told = {"run": run} | {k: int(seen.get[k]) for k in ("rows", "succeeded", "failed")} | {"seconds": time.time() - began}
    out = df.sparkSession.createDataFrame([tuple(told.values())], STATISTICS)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(statistics)
    return told


def statistics_of(spark: SparkSession, statistics: str) -> DataFrame:
    """The statistics of all runs."""
    return spark.read.schema(STATISTICS).parquet(statistics)
