"""A training corpus from ``documents``: five stages, each written before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from brinework.llm._shared import materialize, scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold of their language.

    Null and empty texts are scored as texts without words; repeated rows are
    judged alike; a null or unlearned language takes the threshold of all.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxicity") < F.col("toxicity_threshold")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Texts without words belong to no group and stay.  A group none of whose
    rows has an id keeps the rows of one text; rows that agree in id and
    n-grams stay or go together.
    """
    return ngram_join.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, judged by their text, with or without an id; null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; rows without words are not taken.

    Rows match by a hash of id, text and source, so null ids and ids that
    repeat are taken too.  Rows that agree in all three share out their copies.
    """
    taken = mixing.mix_sources(docs).select(F.col("row_key").alias("_bw_key"), F.col("doc_id").alias("_bw_doc"), "copies")
    taken = taken.groupBy("_bw_key", "_bw_doc").agg(F.sum("copies").alias("_bw_copies"), F.count("*").alias("_bw_rows"))
    taken = materialize(taken.where(F.col("_bw_copies") > 0), "taken")
    rows = docs.withColumn("_bw_own", mixing.row_key()).join(taken, (F.col("_bw_own") == F.col("_bw_key")) & F.col("doc_id").eqNullSafe(F.col("_bw_doc")))
    single = rows.where(F.col("_bw_rows") == 1)
    equal = rows.where(F.col("_bw_rows") > 1)
    nth = F.row_number().over(Window.partitionBy("_bw_own", "doc_id").orderBy("_bw_own"))
    share = F.floor(F.col("_bw_copies") / F.col("_bw_rows")) + (nth <= F.col("_bw_copies") % F.col("_bw_rows")).cast("long")
    equal = equal.withColumn("_bw_copies", share).where(F.col("_bw_copies") > 0)
    rows = single.unionAll(equal).withColumn("_bw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_bw_copies"))))
    return rows.select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; null ids and texts are numbered first, copies each have a slot."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return sharding.shard(rows, 40, text="text_hash").select("doc_id", "source", "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix), ("shard", shard)]

#: The stages learn models and draw at random; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's result is written to the shared folder and read again.

    A stage's intermediate tables are deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
