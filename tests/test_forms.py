import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brinework.operators import context, dedupe, narration, rerank, structured
from brinework.operators import metrics as M
from brinework.operators.store import VectorTable
from brinework.plans import sql_functions
from brinework.sources import writers
from brinework.streaming import increments

ROWS = [
    ("자기주식 취득", {"1. 계약금액": "1,000,000,000"}, "1. 계약금액: 10억원"),
    ("자기주식 신탁", {"보통주식": "12345"}, "보통주식: 12,345주"),
    ("자기주식 취득", {"비율": "5.1"}, "비율: 5.1%"),
    ("자기주식 취득", {"비율": None}, None),
    ("자기주식 취득", {"시작일": "2025년 1월 10일", "보통주식(주)": "1000주", "비율": "2%"}, "회사는 자기주식 취득 신탁계약을 체결했습니다. 계약 시작일은 2025-01-10입니다. 계약 전 자기주식 보유현황은 1,000주, 비율 2%입니다."),
    ("기타", {"신용등급": "AA-", "평가일": "-"}, "회사는 AA- 등급을 받았습니다."),
    ("요약", {"2024년 01월 01일": "2024년 09월 30일"}, "회사의 2024년도 사업연도는 2024-01-01부터 2024-09-30까지입니다."),
    ("요약", {"벤처기업 해당여부": "미해당"}, "회사는 벤처기업에 해당하지 않습니다."),
    ("손익 계산서", {"매출": "-", "제 5 기말": "10"}, "제5기 말 10원"),
    ("배당", {"배당금": "1000"}, "주당 1,000원을 지급했습니다"),
    ("임원", {"성명": "가나"}, "성명: 가나"),
    (None, {"가": "나", "다": "-"}, "가: 나"),
    ("재무", {}, None),
    ("재무", None, None),
    ("", {"가": "-"}, None),
]


def test_sentences_of_rows(spark):
    df = spark.createDataFrame([(i, s, d) for i, (s, d, _) in enumerate(ROWS)], "i int, section string, data map<string,string>")
    got = {r.i: r.said for r in df.select("i", narration.narrated("section", "data").alias("said")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(ROWS)}


def test_header_rows(spark):
    df = spark.createDataFrame([(["구 분", "구  분", "a"], ["", "", "b"], [True, True, False], [True, True, True]), (["구 분", "구 분", "a"], ["1", "2", "3"], [True] * 3, [False] * 3), (["x"], None, [True], None)], "a array<string>, b array<string>, fa array<boolean>, fb array<boolean>")
    m = structured.merged_header(F.col("a"), F.col("b"), F.col("fa"), F.col("fb"))
    assert [tuple(r.m) for r in df.select(m.alias("m")).collect()] == [(["구 분(대)", "구 분(소)", "b"], True), (["구 분", "구 분", "a"], False), (["x"], False)]


def test_semantic_rerank_and_purposes(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, "profit growth", "weather today"), (1, 2, 0.4, "profit growth", "growth of profit"), (1, 3, 0.1, "profit growth", None)], "query_id int, rank int, similarity double, query string, content string")
    assert [r.content for r in rerank.semantic(rows, top=2).orderBy("rank").collect()] == ["growth of profit", "weather today"]
    assert rerank.unchanged(rows, top=1).count() == 1
    (qa,) = context.purpose_context(rows, "qa", most=2).collect()
    assert "질문: profit growth" in qa.context and "2. (유사도: 0.400) growth of profit" in qa.context and "3." not in qa.context
    assert "[문서 3]\n\n\n" in context.purpose_context(rows, "summarization").first().context
    with pytest.raises(ValueError):
        context.purpose_context(rows, "other")


def test_summaries_count_failures(spark):
    runs = spark.createDataFrame([("x", 5.0, 1, None), (None, 3.0, 4, 0.5), (None, None, None, None)], "error string, time_ms double, documents_found int, avg_similarity double")
    assert tuple(M.timing_summary(runs).first()) == (3, 2, 1, 3.0, 1.5, 2.0, 0.25)
    assert tuple(M.timing_summary(runs.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def test_store(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("m", "a", [1.0, 0.0]), ("m", "b", [0.0, 1.0]), ("n", "a", [1.0])], "model string, chunk_id string, embedding array<double>")
    store = VectorTable(chunks, vectors.limit(0)).embed(vectors).insert(spark.createDataFrame([("b", "z"), ("c", "w"), ("c", "v")], chunks.schema))
    assert sorted(tuple(r) for r in store.chunks.collect()) == [("a", "x"), ("b", "y"), ("c", "v")]
    assert [r.chunk_id for r in store.pending("m").collect()] == ["c"]
    queries = spark.createDataFrame([(1, [0.1, 1.0])], "query_id int, query_vector array<double>")
    assert [r.chunk_id for r in store.search(queries, "m", k=1).collect()] == ["b"]
    rest = store.delete(spark.createDataFrame([("a",)], "chunk_id string"))
    assert sorted(tuple(r) for r in rest.statistics().collect()) == [("m", 1, 1)]
    assert rest.truncate().statistics().count() == 0


def test_sql_functions(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("m", "a", [1.0, 0.0]), ("m", "b", [0.6, 0.8]), ("m", "c", [-1.0, 0.0])], "model string, chunk_id string, embedding array<double>")
    sql_functions.register(spark, chunks, vectors)
    got = spark.sql("SELECT chunk_id, similarity, rank FROM search_similar_chunks(array(1D, 0D), 'm')").collect()
    assert sorted(tuple(r) for r in got) == [("a", 1.0, 1), ("b", 0.6, 2)]
    assert tuple(spark.sql("SELECT cosine_similarity(NULL, array(1D)), cosine_similarity(array(1D), array(1D, 2D)), cosine_similarity(array(0D), array(1D))").first()) == (None, 0.0, 0.0)
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM search_similar_chunks(array(1D, 0D), 'none')").collect()


def test_tables_and_batches(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0)], "id int, value double")
    for p in (a, b):
        df.write.parquet(p)
    assert [t.count() for t in dedupe.delete_cascade(df, df.limit(0), ["id"], df)] == [3, 3]
    runs = str(tmp_path / "runs")
    for name in ("one", "two", "one"):
        writers.evaluations(df, runs, run=name)
    assert spark.read.parquet(runs).count() == 6
    out, tallies = str(tmp_path / "out"), str(tmp_path / "tallies")
    for _ in range(2):
        increments.insert_stream(spark, a, "id int, value double", out, tallies, str(tmp_path / "cp"), valid=F.col("value") > 0)
    assert [r.id for r in spark.read.parquet(out).collect()] == [1]
    assert [(r.n, r.succeeded, r.failed, r.accepted) for r in spark.read.parquet(tallies).collect()] == [(3, 1, 2, False)]
    writers.truncate(spark, a, b)
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 0
