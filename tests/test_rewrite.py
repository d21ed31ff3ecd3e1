import datetime as dt

import pytest
from pyspark.sql import functions as F

from brinework.operators import context, rewrite, search

DAY = dt.date(2024, 5, 20)


@pytest.fixture(scope="module")
def filings(spark):
    rows = [(0, "c1", "현대자동차(주)", "005380", "20240301", "사업보고서"), (1, "c1", "현대자동차(주)", "005380", "20240515", "분기보고서"), (2, "c2", "한빛", "", "20230101", "반기보고서"), (3, "c3", None, "1", "20240101", "x")]
    return spark.createDataFrame(rows, "seq int, corp_code string, corp_name string, stock_code string, rcept_dt string, report_nm string")


def test_latest_filing_of_each_company(filings):
    got = {(r.corp_code, r.rcept_dt) for r in rewrite.latest_filings(filings).collect()}
    assert got == {("c1", "20240515"), ("c2", "20230101")}


def test_questions_are_rewritten_with_time_and_companies(spark, filings):
    asked = {1: "한빛의 매출은?", 2: "2023년 한빛의 매출은?", 3: "아무 회사도 없는 질문", 4: "2022년 실적", 5: None, 6: "종목 005380 배당"}
    out = {r.query_id: r.rewritten for r in rewrite.rewrite(spark.createDataFrame(list(asked.items()), "query_id int, question string"), filings, DAY).collect()}
    assert set(out) == set(asked)
    # without a hint of time the latest filing stands in front
    assert out[1].startswith("최신 공시 기준 기업: 한빛(") and "한빛의 매출은?" in out[1]
    assert out[2].startswith("2023년 한빛의 매출은?") and "연도: 2023년" in out[2] and "기업: 한빛(" in out[2]
    assert out[3] == asked[3]
    assert out[4].startswith(asked[4]) and "연도: 2022년" in out[4]
    assert "현대자동차" in out[6] and "분기보고서" in out[6]


def test_context_stands_between_its_neighbours(spark):
    rows = spark.createDataFrame([("a", "b", "c"), (None, "b", ""), (None, None, None)], "prev_context string, content string, next_context string")
    got = [r.enriched for r in search.with_context(rows).collect()]
    assert got[0] == "[이전 문맥]\na\n[검색된 내용]\nb\n[다음 문맥]\nc" and got[1] == "[검색된 내용]\nb" and got[2] == ""


def test_policy_facts_by_kind_of_sentence(spark):
    text = "금리는 연 3.5%입니다. 한도는 1억원 이내입니다. 신청 자격은 청년입니다.\n기타 안내."
    facts = spark.createDataFrame([(text,)], "t string").select(context.policy_facts(F.col("t")).alias("f")).first().f
    assert facts.rates == ["금리는 연 3.5%입니다."] and facts.limits == ["한도는 1억원 이내입니다."] and facts.conditions == ["신청 자격은 청년입니다."]


def test_levels_as_a_table(spark):
    rows = {r.level: (r.top_k, r.rerank_n, r.max_context) for r in context.level_table(spark).collect()}
    assert rows == {k: tuple(v) for k, v in context.LEVELS.items()}
