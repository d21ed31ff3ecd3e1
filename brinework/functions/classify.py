"""Labels of documents and chunks from their names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinework.functions.text import _col

#: Finance terms that become keyword tags.
FINANCE_TERMS = ("자산", "부채", "자본", "매출", "영업이익", "당기순이익", "현금", "유동", "비유동", "감가상각", "이자", "배당", "주식", "보통주", "우선주")
#: Fund brands that are no companies.
FUND_BRANDS = ("TIGER", "KODEX", "ACE", "HANARO", "ARIRANG", "KBSTAR", "TIMEFOLIO")


def doc_type(name: str | Column) -> Column:
    name = F.coalesce(_col(name), F.lit(""))
    return F.when(name.contains("감사보고서"), "audit_report").when(name.contains("사업보고서"), "business_report").when(name.contains("분기보고서"), "quarterly_report").otherwise("other")


def data_category(section: str | Column, text: str | Column) -> Column:
    section, text = F.coalesce(_col(section), F.lit("")), F.coalesce(_col(text), F.lit(""))
    return (
        F.when(section.rlike("재무상태표|손익계산서|현금흐름"), "financial_statement")
        .when(section.contains("주식"), "stock_info")
        .when(section.contains("감사") & text.contains("의견"), "audit_opinion")
        .when(section.contains("주석"), "footnote")
        .otherwise("general")
    )


def fiscal_year(text: str | Column, data: str | Column | None = None) -> Column:
    """The first 20dd in the values of a map whose key names a period, else the first in the text."""
    found = F.regexp_extract(F.coalesce(_col(text), F.lit("")), r"(20\d{2})", 1).try_cast("int")
    if data is None:
        return found
    periods = F.filter(F.map_entries(_col(data)), lambda e: e["key"].rlike("기|년도") & e["value"].rlike(r"20\d{2}"))
    return F.coalesce(F.regexp_extract(F.try_element_at(periods, F.lit(1))["value"], r"(20\d{2})", 1).try_cast("int"), found)


def keyword_tags(text: str | Column, data: str | Column | None = None, *, terms: tuple[str, ...] = FINANCE_TERMS, most: int = 10) -> Column:
    """Map keys and finance terms in the text: distinct, sorted, at most ``most``."""
    text = F.coalesce(_col(text), F.lit(""))
    present = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
    if data is not None:
        present = F.array_union(F.coalesce(F.map_keys(_col(data)), F.array().cast("array<string>")), present)
    return F.slice(F.array_sort(F.array_distinct(present)), 1, most)


def is_fund(name: str | Column) -> Column:
    return _col(name).rlike("|".join(FUND_BRANDS))
