"""Instruction-tuning records from cleaned reports or conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.functions.text import condensed, html_text, zero_width_removed
from brinework.operators.chunking import sentence_splitter, split_rows
from brinework.operators.dedupe import keep_first


def clean_reports(reports: DataFrame, *, title: str = "title", subtitle: str = "subtitle", body: str = "body", order: str = "row", least: int = 100) -> DataFrame:
    """Bodies without tags, longer than ``least`` characters, the first row of each (title, subtitle)."""
    rows = reports.withColumn(body, html_text(body)).where(F.length(body) > least)
    return keep_first(rows, [title, subtitle], [order])


def chunk_reports(reports: DataFrame, *, text: str = "body") -> DataFrame:
    return split_rows(reports, sentence_splitter, text=text, part="chunk_text").where(F.trim("chunk_text") != "")


def records(rows: DataFrame, *, instruction: str, input_col: str, output_col: str, key: str, task: str = "summary", limit: int = 8000) -> DataFrame:
    """instruction, input, output, meta, task; rows with a blank instruction or output are left out."""
    clean = zero_width_removed
    out = rows.select(
        F.col(key).alias("_key"),
        clean(instruction).alias("instruction"),
        clean(input_col, limit=limit).alias("input"),
        condensed(clean(output_col)).alias("output"),
        F.struct(F.format_string("report_%s", F.col(key).cast("string")).alias("report_id")).alias("meta"),
        F.lit(task).alias("task"),
    )
    full = lambda c: F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", "")) > 0
    return out.where(full("instruction") & full("output"))


def train_test(df: DataFrame, key: str, *, tenths: int = 1, seed: int = 42) -> DataFrame:
    """``split``: test for about ``tenths`` tenths of the keys, by a hash; the same on every run and partitioning."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10)) < tenths, "test").otherwise("train"))
