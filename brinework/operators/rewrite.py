"""Questions enriched with their time and companies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.functions.dates import compact_date, has_time_hint, temporal
from brinework.functions.text import aliases
from brinework.operators.dedupe import keep_latest
from brinework.operators.joins import question_companies


def latest_filings(filings: DataFrame, *, order: str = "seq") -> DataFrame:
    """The latest filing of each company, the later record on equal dates, with one row per alias of its name."""
    last = keep_latest(filings.where(F.col("corp_name").isNotNull()), ["corp_code"], ["rcept_dt", order])
    return last.select("corp_code", "corp_name", F.col("stock_code").alias("ticker"), "rcept_dt", "report_nm", F.explode(aliases("corp_name")).alias("alias"))


def rewrite(questions: DataFrame, filings: DataFrame, as_of: dt.date) -> DataFrame:
    """``rewritten`` and ``temporal``: the question with years, quarters, relative time, range and companies.

    Without any time hint the latest filing dates of the named companies stand in front.
    """
    timed = questions.withColumn("temporal", temporal("question", as_of))
    found = question_companies(questions.select("query_id", "question"), latest_filings(filings))
    said = F.concat(F.col("corp_name"), F.lit("("), F.concat_ws(", ", F.nullif(F.col("ticker"), F.lit("")), compact_date("rcept_dt"), F.col("report_nm")), F.lit(")"))
    named = found.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(said)), ", ").alias("_companies"))
    t = F.col("temporal")

    def listed(c, unit):
        return F.when(F.size(c) > 0, F.concat(F.array_join(F.transform(c, lambda x: F.concat(x.cast("string"), F.lit(unit))), ", ")))

    time = F.concat_ws(
        " / ",
        F.concat(F.lit("연도: "), listed(t["years"], "년")),
        F.concat(F.lit("분기: "), listed(t["quarters"], "분기")),
        F.concat(F.lit("상대 시점: "), t["relative"]),
        F.concat(F.lit("기간: "), t["range"]["start"], F.lit("~"), t["range"]["end"]),
    )
    out = timed.join(named, "query_id", "left").withColumn("_time", F.nullif(time, F.lit("")))
    company = F.concat(F.lit("기업: "), F.col("_companies"))
    late = F.concat_ws(" / ", F.col("question"), F.col("_time"), company)
    text = F.when(has_time_hint("question"), late).otherwise(F.concat_ws(" / ", F.concat(F.lit("최신 공시 기준 "), company), F.col("question"), F.col("_time")))
    return out.withColumn("rewritten", F.when(F.col("_companies").isNull(), late).otherwise(text)).drop("_time", "_companies")
