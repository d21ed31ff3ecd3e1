"""Sentences of table rows, rows built from the columns of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.operators import narration, structured
from brinework.queries import query, table


def _row(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _amount_sql(n: str) -> str:
    def by(size: int, unit: str) -> str:
        return f"CASE WHEN {n} % {size} = 0 THEN format('{{:,}}', {n} // {size}) ELSE format('{{:,.1f}}', {n} / {size}) END || '{unit}'"

    return f"CASE WHEN {n} >= 100000000 THEN {by(10**8, '억원')} WHEN {n} >= 10000 THEN {by(10**4, '만원')} ELSE format('{{:,}}', {n}) || '원' END"


_KOREAN = "yyyy'년' MM'월' dd'일'"


@query(
    f"WITH v AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(floor(o_totalprice) AS BIGINT) * 1000 AS n, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS z FROM orders) "
    f"SELECT o_orderkey, '회사는 ' || a || '에 자기주식 취득 신탁계약 체결을 결정했습니다. 계약금액은 ' || {_amount_sql('n')} || '입니다. ' || CASE s WHEN 'F' THEN '계약기간은 ' || a || '부터 ' || z || '까지입니다.' ELSE '계약 시작일은 ' || a || '입니다.' END || ' 취득 목적은 ''' || p || '''입니다. 계약 전 자기주식 보유현황은 비율 5%입니다.' AS said FROM v"
)
def sentence_treasury_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.date_format("o_orderdate", _KOREAN), F.date_format(F.date_add("o_orderdate", 90), _KOREAN)
    data = F.create_map(
        F.lit("1. 계약금액"), (F.floor("o_totalprice") * 1000).cast("string"), F.lit("2. 계약기간 > 시작일"), start, F.lit("2. 계약기간 > 종료일"), F.when(F.col("o_orderstatus") == "F", end).otherwise("-"),
        F.lit("3. 계약목적"), F.col("o_orderpriority"), F.lit("4. 이사회결정일"), start, F.lit("5. 비율"), F.lit("5"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", narration.narrated(F.lit("자기주식 취득 신탁계약"), data).alias("said"))


@query(
    "SELECT o_orderkey, c_name || '는 ' || strftime(o_orderdate, '%Y-%m-%d') || '에 ' || c_mktsegment || '로부터 ' || o_orderstatus || ' 등급을 (' || o_orderpriority || ') 받았습니다.' AS said FROM orders JOIN customer ON c_custkey = o_custkey"
)
def sentence_credit_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    data = _row(평가일=F.date_format("o_orderdate", _KOREAN), 신용평가기관=F.col("c_mktsegment"), 신용등급=F.col("o_orderstatus"), 평가목적=F.lit("-"), 평가구분=F.col("o_orderpriority"))
    return rows.select("o_orderkey", narration.narrated(F.lit(None).cast("string"), data, "c_name").alias("said"))


@query(
    f"WITH v AS (SELECT p_partkey, p_name, p_size, p_brand, CAST(floor(p_retailprice) AS BIGINT) * 10 AS n, CAST(floor(p_retailprice) AS BIGINT) AS m FROM part) "
    f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END || '은(는) 제27기(당기) 말 ' || {_amount_sql('n')} || ', 제26기(전기) 초 ' || {_amount_sql('m')} || CASE WHEN p_size % 3 = 0 THEN ', 2023년 ' || {_amount_sql('n')} ELSE '' END || '입니다' || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' (주석 ' || p_size || ')' END AS said FROM v"
)
def sentence_financial(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.floor("p_retailprice"), F.col("p_size")
    data = F.create_map(
        F.lit("과 목"), F.when(size % 2 == 0, F.col("p_name")).otherwise("-"), F.lit("세목"), F.col("p_brand"), F.lit("제 27(당) 기말"), (n * 10).cast("string"), F.lit("제 26(전) 기초"), n.cast("string"),
        F.lit("2023년"), F.when(size % 3 == 0, (n * 10).cast("string")).otherwise(""), F.lit("주 석"), F.when(size % 5 == 0, F.lit(None)).otherwise(size.cast("string")),
    )
    return table(spark, sf_dir, "part").select("p_partkey", narration.narrated(F.lit("재 무 상태표"), data).alias("said"))


@query(f"WITH v AS (SELECT *, CAST(floor(p_retailprice) AS BIGINT) * 100 AS n FROM part) SELECT p_partkey, p_name || '의 ' || p_brand || '은(는) ' || format('{{:,}}', p_size * 1000) || '주이며' || CASE WHEN p_size > 20 THEN ' 금액은 ' || {_amount_sql('n')} || '입니다' ELSE '' END AS said FROM v")
def sentence_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _row(주식종류=F.col("p_brand"), 발행주식수=F.col("p_size") * 1000, 금액=F.when(F.col("p_size") > 20, F.floor("p_retailprice") * 100))
    return table(spark, sf_dir, "part").select("p_partkey", narration.narrated(F.lit("주식의 총수"), data, "p_name").alias("said"))


@query("SELECT c_custkey, c_name || '는 ' || c_mktsegment || ' 결산기에 ' || CASE WHEN c_nationkey = 0 THEN '' ELSE '주당 ' || format('{:,}', c_nationkey * 500) || '원을 ' END || '배당률 ' || c_nationkey || '%로 지급했습니다' AS said FROM customer")
def sentence_dividend(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    data = _row(결산기=F.col("c_mktsegment"), 주당배당금=F.when(n == 0, F.lit("-")).otherwise((n * 500).cast("string")), 배당수익률=n)
    return table(spark, sf_dir, "customer").select("c_custkey", narration.narrated(F.lit("배당에 관한 사항"), data, "c_name").alias("said"))


@query("SELECT o_orderkey, 'N' || o_custkey || '은(는) ' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority || '으로 ' END || strftime(o_orderdate, '%Y-%m-%d') || '에 취임했습니다' AS said FROM orders")
def sentence_executive(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _row(성명=F.concat(F.lit("N"), F.col("o_custkey")), 직위=F.when(F.col("o_orderstatus") == "F", "-").otherwise(F.col("o_orderpriority")), 선임일=F.date_format("o_orderdate", "yyyy.MM.dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", narration.narrated(F.lit("임원의 현황"), data).alias("said"))


@query(
    "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag AS f, strftime(l_shipdate, '%Y-%m-%d') AS a, strftime(l_shipdate + INTERVAL 364 DAY, '%Y-%m-%d') AS z FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE f WHEN 'R' THEN '회사의 사업연도는 R입니다.' ELSE '회사의 ' || left(a, 4) || '년도 사업연도는 ' || a || '부터 ' || z || '까지입니다.' END AS said FROM v"
)
def sentence_fiscal_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span as key and value, as marked keys, or only a year, by the return flag."""
    flag, start, end = F.col("l_returnflag"), F.date_format("l_shipdate", _KOREAN), F.date_format(F.date_add("l_shipdate", 364), _KOREAN)
    data = (
        F.when(flag == "R", F.create_map(F.lit("사업연도"), flag, F.lit("비고"), F.lit("-")))
        .when(flag == "A", F.create_map(start, end))
        .otherwise(F.create_map(F.lit("사업연도"), F.lit("부터"), start, F.lit("부터"), F.lit("종료"), end))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", narration.narrated(F.lit(""), data).alias("said"))


@query(
    "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN s_name || '는 중소기업, 벤처기업에 해당합니다.' WHEN 1 THEN s_name || '는 중소기업에 해당합니다. 중견기업에는 해당하지 않습니다.' ELSE s_name || '는 중소기업, 중견기업에 해당하지 않습니다.' END AS said FROM supplier"
)
def sentence_company_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_nationkey") % 3
    data = F.create_map(
        F.lit("중소기업 해당 여부"), F.when(k == 2, "미해당").otherwise("해당"), F.lit("중견기업 해당 여부"), F.when(k == 0, "-").otherwise("미해당"),
        F.lit("벤처"), F.when(k == 0, "벤처기업 해당").otherwise("-"), F.lit("중소기업"), F.when(k == 2, "미해당").otherwise("해당"),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", narration.narrated(F.lit("기타"), data, "s_name").alias("said"))


@query("SELECT p_partkey, ['구 분(대)', '구 분(소)', CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END, p_name, ''] AS header, p_size % 3 <> 0 AS two_rows FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, ['구 분', '구 분', p_brand, '', ''], false FROM part WHERE p_size % 3 = 0")
def header_rows_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two header rows as one, and the first alone where the second holds data."""
    size = F.col("p_size")
    first = F.array(F.lit("구 분"), F.lit("구 분"), F.col("p_brand"), F.lit(""), F.lit(""))
    second = F.array(F.lit(""), F.lit(" "), F.when(size % 2 == 0, F.col("p_type")), F.col("p_name"), F.lit(None).cast("string"))
    heads = F.array_repeat(size % 3 != 0, 5)
    merged = structured.merged_header(first, second, F.array_repeat(F.lit(True), 5), heads)
    return table(spark, sf_dir, "part").select("p_partkey", merged["header"].alias("header"), merged["merged"].alias("two_rows"))
