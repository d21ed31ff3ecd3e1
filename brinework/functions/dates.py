"""Dates in text, and time expressions in questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinework.functions.text import _col

#: What makes a question one about recent, past or compared figures.
RECENT, TREND = "최근|최신|현재", "추이|변화|트렌드|증감|성장|감소|증가"
LAST_YEAR, LAST_QUARTER, COMPARISON = "작년|전년|지난해", r"전\s*분기|이전\s*분기", "비교|대비|차이"
TIME_HINT = r"(?i)\b\d{4}\s*년|\b\d{2}\s*년|\b\d{4}[-./]\d{1,2}|\b\d{8}\b|분기|반기|최근|yoy|qoq"


def iso_dates(c: str | Column) -> Column:
    """Korean and dotted dates as YYYY-MM-DD, ``제 54 기`` as ``제54기``."""
    c = _col(c)
    for pattern, by in (
        (r"(\d{4})년\s*(\d{2})월\s*(\d{2})일", "$1-$2-$3"),
        (r"(\d{4})년\s*(\d)월\s*(\d{2})일", "$1-0$2-$3"),
        (r"(\d{4})년\s*(\d{2})월\s*(\d)일", "$1-$2-0$3"),
        (r"(\d{4})년\s*(\d)월\s*(\d)일", "$1-0$2-0$3"),
        (r"(\d{4})\.(\d{2})\.(\d{2})", "$1-$2-$3"),
        (r"(\d{4})주-(\d{2})-(\d{2})", "$1-$2-$3"),
        (r"제\s*(\d+)\s*기", "제$1기"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c


def may_have_dates(c: str | Column) -> Column:
    """False only for texts that :func:`iso_dates` leaves as they are."""
    c = _col(c)
    return F.contains(c, F.lit("년")) | F.contains(c, F.lit("제")) | F.contains(c, F.lit("주-")) | c.rlike(r"\.\d{2}\.\d{2}")


def compact_date(c: str | Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything else unchanged."""
    c = _col(c)
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("yyyyMMdd")), "yyyy-MM-dd"), c)


def _ints(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def years(c: str | Column) -> Column:
    """Years named in a question, sorted; two digits before 년 count from 2000, tails of longer numbers don't."""
    c = F.coalesce(_col(c), F.lit(""))
    short = F.transform(_ints(c, r"(?<!\d)(\d{2})년"), lambda y: y + 2000)
    return F.array_sort(F.array_distinct(F.concat(_ints(c, r"(20\d{2})년?"), short)))


def quarters(c: str | Column) -> Column:
    """Quarters named in a question, sorted."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.array_sort(F.array_distinct(F.concat(_ints(c, "([1-4])분기"), _ints(c, "(?i)Q([1-4])"), _ints(c, "제([1-4])사분기"))))


def relative_time(c: str | Column) -> Column:
    """trend, recent_<n>_<unit>, recent, last_year, last_quarter, comparison or null; the first that fits."""
    c = _col(c)
    counted = r"최근\s*(\d+)\s*(분기|년|개월)"
    recent = F.when(c.rlike(TREND), F.lit("trend")).when(c.rlike(counted), F.concat_ws("_", F.lit("recent"), F.regexp_extract(c, counted, 1), F.regexp_extract(c, counted, 2))).otherwise("recent")
    return F.when(c.rlike(RECENT), recent).when(c.rlike(LAST_YEAR), "last_year").when(c.rlike(LAST_QUARTER), "last_quarter").when(c.rlike(COMPARISON), "comparison")


def date_range(c: str | Column) -> Column:
    """struct<start, end> of an explicit range of ISO dates, or null."""
    c, pattern = _col(c), r"(\d{4}-\d{2}-\d{2})\s*(?:부터|에서|~)\s*(\d{4}-\d{2}-\d{2})\s*까지"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("start"), F.regexp_extract(c, pattern, 2).alias("end")))


def temporal(c: str | Column, as_of: dt.date) -> Column:
    """struct<years, quarters, relative, range, pairs> of a question, read on the day ``as_of``.

    ``pairs`` are the exact (year, quarter) pairs of a counted or trend
    expression; years and quarters alone admit other combinations too.
    """
    c = _col(c)
    year, quarter = as_of.year, (as_of.month - 1) // 3 + 1
    said_years, said_quarters, rel = years(c), quarters(c), relative_time(c)
    unit = F.regexp_extract(rel, r"_(분기|년|개월)$", 1)
    count = F.when(rel == "trend", F.lit(3)).otherwise(F.try_element_at(F.split(rel, "_"), F.lit(2)).try_cast("int"))
    back = F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)) - 1), lambda i: F.lit(year * 4 + quarter - 1) - i)
    run_years, run_quarters = F.transform(back, lambda n: F.floor(n / 4).cast("int")), F.transform(back, lambda n: (n % 4 + 1).cast("int"))
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    by_quarter = ((rel == "trend") & (F.size(said_quarters) == 0)) | (unit == "분기")
    last = year * 4 + quarter - 2
    ys = (
        F.when((rel == "recent") & (F.size(said_years) == 0), F.array(F.lit(year)))
        .when(rel == "last_year", F.array(F.lit(year - 1)))
        .when(rel == "last_quarter", F.array(F.lit(last // 4)))
        .when(by_quarter, tidy(run_years))
        .when(unit == "년", tidy(F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)) - 1), lambda i: F.lit(year) - i)))
        .otherwise(said_years)
    )
    qs = F.when((rel == "recent") & (F.size(said_quarters) == 0), F.array(F.lit(quarter))).when(rel == "last_quarter", F.array(F.lit(last % 4 + 1))).when(by_quarter, tidy(run_quarters)).otherwise(said_quarters)
    pairs = F.when(by_quarter, F.arrays_zip(run_years.alias("year"), run_quarters.alias("quarter")))
    return F.struct(ys.alias("years"), qs.alias("quarters"), rel.alias("relative"), date_range(c).alias("range"), pairs.alias("pairs"))


def with_temporal(question: str | Column, info: Column) -> Column:
    """The question with its years and quarters appended."""
    def listed(a: Column, unit: str) -> Column:
        return F.when(F.size(a) > 0, F.concat_ws(", ", F.transform(a, lambda x: F.concat(x.cast("string"), F.lit(unit)))))

    return F.concat_ws(" ", _col(question), listed(info["years"], "년"), listed(info["quarters"], "분기"))


def has_time_hint(c: str | Column) -> Column:
    return _col(c).rlike(TIME_HINT)


def temporal_filter(info: Column, year: Column, quarter: Column, day: Column) -> Column:
    """Whether a row's year, quarter and day (YYYYMMDD text) fit the question; what it doesn't say is free."""
    in_pairs = F.exists(info["pairs"], lambda p: (p["year"] == year) & (p["quarter"] == quarter))
    free = ((F.size(info["years"]) == 0) | F.array_contains(info["years"], year)) & ((F.size(info["quarters"]) == 0) | F.array_contains(info["quarters"], quarter))
    span = info["range"]
    return F.when(info["pairs"].isNotNull(), in_pairs).otherwise(free) & (span.isNull() | day.between(F.replace(span["start"], F.lit("-"), F.lit("")), F.replace(span["end"], F.lit("-"), F.lit(""))))
