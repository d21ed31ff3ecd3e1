"""A stored table in hash buckets of its keys, of which an upsert rewrites only those it touches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.operators.dedupe import keep_latest, upsert

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketedTable:
    """Parquet folders ``bucket=n`` below ``path``; the row with the largest ``order`` stays of each key.

    An upsert writes the new contents of the buckets it touches beside the
    table first, and then puts them in place.  If it is stopped in between, the
    next one, or :meth:`recover`, puts them in place; one that is repeated
    changes nothing.  One writer at a time.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _folder(self, spark: SparkSession, path: str):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder

    def _staged(self, spark: SparkSession) -> list[str]:
        """Folders of upserts that were written whole, but not put in place."""
        files, folder = self._folder(spark, f"{self.path}.staged")
        if not files.exists(folder):
            return []
        found = [str(s.getPath()) for s in files.listStatus(folder)]
        return sorted(p for p in found if not p.endswith(".part"))

    def _write(self, df: DataFrame) -> None:
        """Puts whole buckets in place of those in the table."""
        df.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, df: DataFrame) -> None:
        self._write(self._bucketed(keep_latest(df, list(self.keys), list(self.order))))

    def recover(self, spark: SparkSession) -> None:
        """Puts upserts in place that were stopped before, and drops what was not written whole."""
        for path in self._staged(spark):
            self._write(spark.read.parquet(path))
        files, folder = self._folder(spark, f"{self.path}.staged")
        files.delete(folder, True)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def stage(self, incoming: DataFrame) -> None:
        """The first half of an upsert: the new contents of the buckets of incoming keys, beside the table."""
        spark = incoming.sparkSession
        fresh = self._bucketed(keep_latest(incoming, list(self.keys), list(self.order)))
        touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        old = spark.read.parquet(self.path).where(F.col(BUCKET).isin(touched))
        merged = upsert(old.select(fresh.columns), fresh, [BUCKET, *self.keys], list(self.order))
        whole = f"{self.path}.staged/{uuid.uuid4().hex}"
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{whole}.part")
        files, folder = self._folder(spark, f"{whole}.part")
        files.rename(folder, self._folder(spark, whole)[1])

    def upsert(self, incoming: DataFrame) -> None:
        """Incoming rows replace rows of the same keys with a smaller or equal ``order``; only their buckets are read and written."""
        self.recover(incoming.sparkSession)
        self.stage(incoming)
        self.recover(incoming.sparkSession)
