"""Text, date and number functions, parsing, chunking and page scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.functions import classify, dates, numbers, text
from brinework.operators import chunking, structured
from brinework.plans import corpus
from brinework.queries import query, table
from brinework.sources import markup, readers


@query(r"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'))) AS h FROM documents")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalised("text")).alias("h"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s.,;:!?()\-]', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def special_char_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.special_chars_removed("text")).alias("h"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def whitespace_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.tidy_space("text")).alias("h"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def html_strip_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text("html")).alias("h"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(html, '(?i)<html[^>]*\slang=["'']?([a-zA-Z-]+)', 1)) AS html_lang, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS INT) AS n_links FROM pages""")
def html_title_lang_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_facts(table(spark, sf_dir, "pages")).select("page_id", "title", "html_lang", "n_links")


@query(
    "WITH c AS (SELECT c_custkey AS page_id, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS m, CAST(c_nationkey AS VARCHAR) AS n, c_name AS w FROM customer) "
    "SELECT page_id, 0 AS table_no, 0 AS row_no, [k, m, m] AS cells FROM c UNION ALL SELECT page_id, 0, 1, [k, n, w] FROM c UNION ALL SELECT page_id, 0, 2, ['', n, m] FROM c"
)
def html_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged cells of a table spread over their span, one table for each customer."""
    html = F.format_string("<table><tr><td rowspan=2>%1$s</td><td colspan=2>%2$s</td></tr><tr><td>%3$s</td><td>%4$s</td></tr><tr><td></td><td>%3$s</td><td>%2$s</td></tr></table>", "c_custkey", "c_mktsegment", "c_nationkey", "c_name")
    return readers.html_tables(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate, '%Y-%m-%d') AS c FROM orders")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings of a date become one."""
    d = F.col("o_orderdate")
    korean = F.concat(F.year(d), F.lit("년 "), F.month(d), F.lit("월 "), F.dayofmonth(d), F.lit("일"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_dates(korean).alias("a"), dates.iso_dates(F.date_format(d, "yyyy.MM.dd")).alias("b"), dates.compact_date(F.date_format(d, "yyyyMMdd")).alias("c"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about time for every order, of one of seven kinds, with numbers from its date."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 7
    said = (
        F.when(kind == 0, F.format_string("%d년 %d분기", F.year(d) + 30, F.quarter(d)))
        .when(kind == 1, F.format_string("최근 %d분기 실적", F.month(d)))
        .when(kind == 2, F.format_string("최근 %d년", F.month(d)))
        .when(kind == 3, F.format_string("%d년 Q%d", F.year(d) - 1980, F.quarter(d)))
        .when(kind == 4, "작년 매출")
        .when(kind == 5, "전 분기")
        .otherwise("최근 실적")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("question"))


_ASKED = "a AS (SELECT o_orderkey, o_orderkey % 7 AS kind, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m FROM orders)"


@query(
    f"WITH {_ASKED}, r AS (SELECT *, range(m) AS back FROM a) SELECT o_orderkey, CASE kind WHEN 0 THEN CAST(y + 30 AS VARCHAR) WHEN 1 THEN array_to_string(list_sort(list_distinct(list_transform(back, lambda i: (8101 - i) // 4))), ',') "
    "WHEN 2 THEN array_to_string(list_sort(list_transform(back, lambda i: 2025 - i)), ',') WHEN 3 THEN CAST(y + 20 AS VARCHAR) WHEN 4 THEN '2024' ELSE '2025' END AS years, "
    "CASE kind WHEN 0 THEN CAST(q AS VARCHAR) WHEN 1 THEN array_to_string(list_sort(list_distinct(list_transform(back, lambda i: (8101 - i) % 4 + 1))), ',') WHEN 3 THEN CAST(q AS VARCHAR) WHEN 5 THEN '1' WHEN 6 THEN '2' ELSE '' END AS quarters FROM r"
)
def temporal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and quarters that questions of May 2025 ask for."""
    t = dates.temporal("question", dt.date(2025, 5, 15))
    return _questions(spark, sf_dir).select("o_orderkey", F.array_join(t["years"].cast("array<string>"), ",").alias("years"), F.array_join(t["quarters"].cast("array<string>"), ",").alias("quarters"))


@query(f"WITH {_ASKED} SELECT o_orderkey, CASE kind WHEN 1 THEN 'recent_' || m || '_분기' WHEN 2 THEN 'recent_' || m || '_년' WHEN 4 THEN 'last_year' WHEN 5 THEN 'last_quarter' WHEN 6 THEN 'recent' END AS relative FROM a")
def relative_time_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("o_orderkey", dates.relative_time("question").alias("relative"))


@query("SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) * 1000 AS VARCHAR) AS scaled FROM orders")
def unit_value_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.format_number(F.floor("o_totalprice"), 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.scaled(value, F.lit("(단위: 천원)")).alias("scaled"))


@query("WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 1000 AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 100000000 THEN CASE WHEN n % 100000000 = 0 THEN format('{:,}', n // 100000000) ELSE format('{:,.1f}', n / 100000000) END || '억원' WHEN n >= 10000 THEN CASE WHEN n % 10000 = 0 THEN format('{:,}', n // 10000) ELSE format('{:,.1f}', n / 10000) END || '만원' ELSE format('{:,}', n) || '원' END AS amount FROM v")
def amount_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.amount((F.floor("o_totalprice") * 1000).cast("string")).alias("amount"))


@query(
    "WITH v AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) * 10000000 AS n FROM orders) SELECT o_orderkey, '총액 ' || CASE WHEN n >= 1000000000000 THEN format('{:.1f}', n / 1000000000000) || '조원' WHEN n % 100000000 = 0 THEN format('{:,}', n // 100000000) || '억원' ELSE format('{:,.1f}', n / 100000000) || '억원' END AS money, "
    "'보유 ' || format('{:,}', o_custkey + 1000) || '주' AS shares FROM v WHERE n >= 1000000000 UNION ALL SELECT o_orderkey, '총액 ' || n, '보유 ' || format('{:,}', o_custkey + 1000) || '주' FROM v WHERE n < 1000000000"
)
def number_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside text get their units."""
    money = F.concat(F.lit("총액 "), (F.floor("o_totalprice") * 10_000_000).cast("string"))
    shares = F.concat(F.lit("보유 "), F.format_number(F.col("o_custkey") + 1000, 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.large_numbers(money).alias("money"), numbers.stock_numbers(shares).alias("shares"))


@query(
    "SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '는' ELSE '은' END AS name, "
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '자동차는' WHEN 'BUILDING' THEN '건물은' WHEN 'FURNITURE' THEN '가구는' WHEN 'MACHINERY' THEN '기계는' WHEN 'HOUSEHOLD' THEN '살림은' ELSE '는' END AS segment FROM customer"
)
def particle_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic particle after names that end in a digit and after Korean words."""
    m = F.col("c_mktsegment")
    word = F.when(m == "AUTOMOBILE", "자동차").when(m == "BUILDING", "건물").when(m == "FURNITURE", "가구").when(m == "MACHINERY", "기계").when(m == "HOUSEHOLD", "살림").otherwise("")
    said = {"name": F.col("c_name"), "segment": word}
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.concat(w, text.particle(w, "은", "는")).alias(k) for k, w in said.items()])


@query("SELECT o_orderkey, '매출: ' || o_custkey || ',' || o_orderstatus AS pairs, '' AS word, o_custkey || ': ' || o_custkey AS number FROM orders")
def repetition_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a word with itself go, numbers stay."""
    pairs = F.concat(F.lit("구분: 구분,매출: "), "o_custkey", F.lit(","), "o_orderstatus")
    twice = {"word": "o_orderpriority", "number": "o_custkey"}
    return table(spark, sf_dir, "orders").select("o_orderkey", text.repetition_reduced(pairs).alias("pairs"), *[text.repetition_reduced(F.concat_ws(": ", c, c)).alias(k) for k, c in twice.items()])


@query("SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'audit_report' ELSE 'other' END AS doc_type FROM documents")
def doc_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.contains("text", F.lit("the")), "2024 감사보고서").otherwise("공시")
    return table(spark, sf_dir, "documents").select("doc_id", classify.doc_type(name).alias("doc_type"))


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 'financial_statement' WHEN 'src2' THEN 'stock_info' WHEN 'src3' THEN 'audit_opinion' WHEN 'src4' THEN 'footnote' ELSE 'general' END AS category FROM documents")
def category_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    section = F.when(s == "src1", "재무상태표").when(s == "src2", "주식의 총수").when(s == "src3", "감사").when(s == "src4", "재무제표 주석").otherwise("개요")
    return table(spark, sf_dir, "documents").select("doc_id", classify.data_category(section, F.concat(F.lit("의견 "), F.col("text"))).alias("category"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(20[0-9]{2})', 1), '') AS INT) AS fiscal_year FROM documents")
def fiscal_year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.fiscal_year("text").alias("fiscal_year"))


@query("SELECT doc_id, list_sort(list_filter(['the', 'and', 'der', 'que', 'les'], lambda t: contains(text, t))) AS tags FROM documents")
def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.keyword_tags("text", terms=("the", "and", "der", "que", "les")).alias("tags"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, 'flag: ' || l_returnflag || ', status: ' || l_linestatus AS said FROM lineitem")
def structured_row_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"), F.lit("note"), F.lit("-"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", structured.pairs_text(data).alias("said"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(user_id AS VARCHAR) ELSE json_extract_string(props, '$.k') END AS winner, event_type AS kept FROM events")
def map_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of an event with its type, and for some events with the user in place of a property."""
    props = F.from_json("props", "map<string,string>")
    user = F.when(F.col("event_type").isin("view", "click"), F.create_map(F.lit("k"), F.col("user_id").cast("string")))
    m = structured.merged(props, F.create_map(F.lit("t"), F.col("event_type")), user)
    return table(spark, sf_dir, "events").select("event_id", m["k"].alias("winner"), m["t"].alias("kept"))


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '보통주는 주식수 ' || (o_custkey + 100) || ', 비율 ' || month(o_orderdate) || '%입니다.' WHEN 'O' THEN '현금배당은 당기 ' || (o_custkey + 100) || ', 전기 ' || month(o_orderdate) || '입니다.' ELSE '가: ' || o_orderpriority END AS said FROM orders"
)
def row_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of table rows by section."""
    status, n, m = F.col("o_orderstatus"), (F.col("o_custkey") + 100).cast("string"), F.month("o_orderdate").cast("string")
    section = F.when(status == "F", "주식의 총수").when(status == "O", "배당").otherwise("기타")
    shares = F.create_map(F.lit("구분"), F.lit("보통주"), F.lit("주식수"), n, F.lit("비율"), F.concat(m, F.lit("%")))
    paid = F.create_map(F.lit("구분"), F.lit("현금배당"), F.lit("당기"), n, F.lit("전기"), m)
    data = F.when(status == "F", shares).when(status == "O", paid).otherwise(F.create_map(F.lit("가"), F.col("o_orderpriority"), F.lit("다"), F.lit("-")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", section.alias("section"), data.alias("data"))
    return rows.select("o_orderkey", structured.sentence("section", "data").alias("said"))


@query("SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, md5(text) AS h FROM documents GROUP BY doc_id, text")
def oversized_split_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of oversized texts, put together, are the texts; the number of texts stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = chunking.split_rows(docs, chunking.oversized_splitter)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split_index", "part"))), lambda p: p["part"]), "")
    back = parts.groupBy("doc_id").agg(whole.alias("t"))
    return back.select("doc_id", F.lit(1).cast("long").alias("n"), F.length("t").cast("long").alias("chars"), F.md5("t").alias("h"))


@query()
def adaptive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), chunking.adaptive_splitter).select("doc_id", "split_index", "total_splits", F.length("part").alias("chars"))


@query()
def table_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), chunking.table_row_splitter).select("doc_id", "split_index", "total_splits", F.length("part").alias("chars"))


@query()
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed, normalised, split, merged, numbered and labelled in one plan."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body"))
    return corpus.build(docs).select("doc_id", "seq", "chunk_id", "chunk_type", "merged_count", "doc_type", "data_category", "token_count")


@query()
def page_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of text of every page with the elements around it, and every error that the reader recovered from."""
    return markup.page_blocks(table(spark, sf_dir, "pages"))
