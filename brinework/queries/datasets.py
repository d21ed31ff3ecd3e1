"""Instruction-tuning datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.operators import chat, sft
from brinework.queries import query, table


@query(r"WITH c AS (SELECT doc_id, source, lang, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM documents) SELECT min(doc_id) AS doc_id, source, lang FROM c WHERE length(body) > 100 GROUP BY source, lang")
def clean_dedupe_minlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned bodies of more than 100 characters, the first of each title."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("subtitle"), F.col("text").alias("body"))
    out = sft.clean_reports(docs, order="doc_id")
    return out.select("doc_id", F.col("title").alias("source"), F.col("subtitle").alias("lang"))


@query("WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id || '_' || turn AS key, text AS instruction, 'summary' AS task FROM n WHERE role = 'user' AND nr = 'assistant' AND length(trim(text)) > 0 AND length(trim(answer)) > 0")
def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns(table(spark, sf_dir, "conversations")).withColumn("key", F.concat_ws("_", "conv_id", "turn")).withColumn("empty", F.lit(""))
    out = sft.records(rows, instruction="text", input_col="empty", output_col="answer", key="key")
    return out.select(F.col("_key").alias("key"), "instruction", "task")


@query()
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.train_test(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id")


@query()
def report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-first chunks of 300 characters with an overlap of 50."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return sft.chunk_reports(docs).select("doc_id", "split_index", "total_splits", F.length("chunk_text").alias("chars"))
