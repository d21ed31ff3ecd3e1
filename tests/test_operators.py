import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinework.catalog import QUERIES
from brinework.functions import text as text_functions
from brinework.functions.dates import iso_dates, may_have_dates
from brinework.operators import chunking, context, dedupe, joins, quiz, rerank, search, sequences, sft, structured
from brinework.operators import metrics as M
from brinework.plans import corpus
from brinework.sources import writers


def test_upsert_prefers_the_incoming_row_on_a_tie(spark):
    old, new = spark.createDataFrame([(1, 5, "a"), (2, 9, "b")], "k int, t int, v string"), spark.createDataFrame([(1, 5, "c"), (2, 1, "d"), (3, 1, "e")], "k int, t int, v string")
    assert sorted(map(tuple, dedupe.upsert(old, new, ["k"], ["t"]).collect())) == [(1, 5, "c"), (2, 9, "b"), (3, 1, "e")]


def test_second_increment_embeds_nothing(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert dedupe.pending(rows, rows, "chunk_id", "chunk_id").count() == 0


def test_name_cascade(spark):
    names = spark.createDataFrame([("현대차",), ("한 빛",), ("한빛우",), ("모름",)], "name string")
    firms = spark.createDataFrame([("현대자동차", "1"), ("한빛", "2")], "corp_name string, corp_code string")
    got = {r.name: (r.code, r.step) for r in map(lambda r: r, joins.match_names(names, firms).withColumnRenamed("name", "n").select(F.col("n").alias("name"), "code", "step").toPandas().itertuples(index=False))}
    assert {k: v[0] for k, v in got.items()} == {"현대차": "1", "한 빛": "2", "한빛우": "2", "모름": None}
    assert [got[k][1] for k in ("현대차", "한 빛", "한빛우")] == [2, 3, 4]


def test_files_of_the_day_by_title_then_path(spark):
    reports = spark.createDataFrame([(1, "20240101", "net sales of steel"), (2, "20240101", "no such"), (3, "20240101", None), (4, "20240102", "sales of"), (5, "20240103", "Profit of the year before"), (6, "20240103", "")], "report_id int, day string, title string")
    files = spark.createDataFrame([("a", "20240101_a", None), ("b", "20240101_b", "other"), ("c", "20240101_c", "the net sales of steelworks"), ("d", "20240102_d", "x"), ("e", "20240102_e", "all sales offered"), ("f", "note", "the profit of the year beforehand")], "path string, name string, body string")
    got = {r.report_id: (r.path, r.matched_by) for r in joins.prefix_or_title(reports, files).collect()}
    assert got == {1: ("c", "day"), 2: ("b", "day"), 3: ("a", "day"), 4: ("e", "day"), 5: ("f", "title"), 6: (None, None)}


def test_a_long_file_of_the_day_is_looked_up_by_its_words(spark):
    body = " ".join(f"w{i}" for i in range(60_000))
    titles = ["w7 w8 w9", "w59998 w59999", "8 w9", "no w8 w9", "w", "x", "9"]
    reports = spark.createDataFrame([(i, "20240101", t) for i, t in enumerate(titles)], "report_id int, day string, title string")
    files = spark.createDataFrame([("z", "20240101_z", body), ("a", "20240101_a", "short")], "path string, name string, body string")
    began = time.time()
    got = {titles[r.report_id]: r.path for r in joins.prefix_or_title(reports, files).collect()}
    assert got == {t: "z" if t in body else "a" for t in titles}
    assert time.time() - began < 60


def test_table_rows_are_cut_in_one_pass():
    text = "abc, d. " * 300_000
    began = time.time()
    parts = chunking.table_row_splitter(text)
    assert "".join(parts) == text and max(map(len, parts)) <= 300 and time.time() - began < 5


def test_comparison_takes_every_model_or_none(spark):
    rows = spark.createDataFrame([(1, f"m{i:02}", float(i)) for i in range(12)], "query_id int, model string, similarity double")
    assert len(writers.comparison(rows, most=12).columns) == 13
    with pytest.raises(ValueError, match="models"):
        writers.comparison(rows, most=11)


def test_matches_run_over_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    assert QUERIES["name_match_cascade"](spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count()
    assert QUERIES["prefix_or_title_match"](spark, sf).where("matched_by = 'day'").count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert QUERIES["title_match_documents"](spark, sf).where("matched_by = 'title'").count() > 0


def test_question_companies_by_alias_and_ticker(spark):
    q = spark.createDataFrame([("Q1", "한 빛 전자의 매출"), ("Q2", "005930 실적"), ("Q3", "아무것도")], "query_id string, question string")
    c = spark.createDataFrame([("한빛전자", "111111"), ("한빛", "111111"), ("삼성", "005930")], "alias string, ticker string")
    got = sorted((r.query_id, r.ticker, r.alias) for r in joins.question_companies(q, c).collect())
    assert got == [("Q1", "111111", "한빛전자"), ("Q2", "005930", "삼성")]


def test_fusion_does_not_depend_on_the_order_of_rows(spark):
    v = spark.createDataFrame([(1, i, 1.0 / i, i) for i in range(1, 9)], "query_id int, chunk_id int, score double, rank int")
    k = spark.createDataFrame([(1, 9 - i, 2.0 / i, i) for i in range(1, 9)], "query_id int, chunk_id int, score double, rank int")
    one = [tuple(r) for r in search.fuse(v, k, k=5).orderBy("rank").collect()]
    assert one == [tuple(r) for r in search.fuse(v.orderBy(F.rand(1)), k.repartition(5), k=5).orderBy("rank").collect()]
    with pytest.raises(ValueError, match="unknown fusion"):
        search.fuse(v, k, method="other")


def test_batch_search_skips_odd_vectors_and_breaks_ties_by_id(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, query_vector array<float>")
    assert [(r.rank, r.vec_id, r.similarity) for r in search.batch_topk(emb, q, k=5).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert search.batch_topk(emb, q.limit(0)).count() == 0


def test_batch_search_takes_queries_of_every_length_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "PART_BYTES", 200)
    rng = np.random.default_rng(5)
    vectors = {i: rng.standard_normal(2 + i % 3).round(2).tolist() for i in range(60)}
    asked = {f"q{i}": rng.standard_normal(2 + i % 4).round(2).tolist() for i in range(17)}
    emb = spark.createDataFrame([*vectors.items(), (98, []), (99, [1.0, None])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([*asked.items(), ("none", [None, 1.0])], "query_id string, query_vector array<double>")
    got = {}
    for r in search.batch_topk(emb, queries, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)

    def cosine(x, y):
        return float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))

    want = {q: [i for i, _ in sorted(((i, cosine(v, x)) for i, x in vectors.items() if len(x) == len(v)), key=lambda p: (-round(p[1], 12), p[0]))[:4]] for q, v in asked.items()}
    assert got == {q: ids for q, ids in want.items() if ids}


def test_keyword_search_by_all_words_or_any(spark):
    chunks = spark.createDataFrame([(1, "Steel sales, steel."), (2, "sales of paper"), (3, "nothing"), (4, ""), (5, None)], "chunk_id int, text string")
    q = spark.createDataFrame([("a", "steel sales"), ("b", "sales"), ("c", ""), ("d", None), ("e", "zinc")], "query_id string, query string")

    def got(**kw):
        return sorted((r.query_id, r.chunk_id, round(r.score, 4), r["rank"]) for r in search.keyword_search(chunks, q, **kw).collect())

    assert got() == [("a", 1, 1.0, 1), ("b", 1, 0.3333, 1), ("b", 2, 0.3333, 2)]
    assert got(match="any") == [("a", 1, 1.0, 1), ("a", 2, 0.3333, 2), ("b", 1, 0.3333, 1), ("b", 2, 0.3333, 2)]
    assert got(match="any", broadcast_words=0) == got(match="any") and len(got(match="any", k=1)) == 2
    with pytest.raises(ValueError, match="unknown match"):
        got(match="some")


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame([(1, i, i, 0.5, "q", "c", 0) for i in (1, 2, 3)], "query_id int, chunk_id int, rank int, similarity double, query string, content string, chunk_index int")
    assert [r.chunk_id for r in rerank.standard(rows).orderBy("rank").collect()] == [1, 2, 3]


def test_packing_never_exceeds_the_budget(spark):
    rows = spark.createDataFrame([(1, i, i, 0.9, " ".join(["w"] * n)) for i, n in enumerate((50, 300, 300, 10), 1)], "query_id int, chunk_id int, rank int, similarity double, content string")
    got = context.pack(rows, budget=500).orderBy("rank").collect()
    assert [(r.words, r.cut) for r in got] == [(50, False), (300, False), (150, True)]


@pytest.mark.parametrize("style", ["prompt", "markdown", "badged", "conversational", "structured", "json"])
def test_every_style_keeps_all_documents(spark, style):
    rows = spark.createDataFrame([(1, f"c{i}", i, 0.8, f"text {i}") for i in (1, 2, 3)], "query_id int, chunk_id string, rank int, similarity double, content string")
    text = context.formatted(context.pack(rows), style=style).first().context
    assert [text.index(f"text {i}") for i in (1, 2, 3)] == sorted(text.index(f"text {i}") for i in (1, 2, 3))


def test_guard_is_added_once(spark):
    row = spark.createDataFrame([("a",)], "x string").select(context.guarded("x").alias("x"))
    assert row.select(context.guarded("x")).first()[0].count(context.DISCLAIMER) == 1


def test_metrics_of_empty_lists_are_zero(spark):
    row = spark.createDataFrame([([], [])], "t array<string>, e array<string>")
    assert tuple(row.select(M.recall_at_k("t", "e"), M.precision_at_k("t", "e"), M.reciprocal_rank("t", "e"), M.ndcg_at_k("t", "e")).first()) == (0.0, 0.0, 0.0, 0.0)


def test_metric_values(spark):
    row = spark.createDataFrame([(["x", "apple pie", "pear"], ["apple", "pear", "plum"])], "t array<string>, e array<string>")
    got = row.select(M.recall_at_k("t", "e"), M.precision_at_k("t", "e"), M.reciprocal_rank("t", "e"), M.ndcg_at_k("t", "e")).first()
    assert list(got) == pytest.approx([2 / 3, 2 / 3, 0.5, (0.63093 + 0.5) / 1.63093], abs=1e-4)


def test_placeholder_truth_does_not_count(spark):
    row = spark.createDataFrame([("값은 XX 입니다", "XX")], "a string, t string")
    assert row.select(M.contains_truth("a", "t")).first()[0] is False


def test_heading_levels_that_are_skipped_nest_siblings(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["# A", "### B", "### C", "## D", "x"])], "doc_id int, line_no int, line string")
    got = {r.line_no: r.path for r in sequences.heading_paths(lines).collect()}
    assert got == {0: "A", 1: "A > B", 2: "A > B > C", 3: "A > D", 4: "A > D"}


def test_greedy_groups(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate((3, 4, 5, 2, 9))], "d int, o int, s int")
    assert [r.group for r in sequences.greedy_groups(rows, partition=["d"], order="o", size="s", budget=8).orderBy("o").collect()] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("text", ["", "a", "word " * 900, "x" * 9000, "가나다. " * 700, "p1\n\n" * 400])
def test_splits_lose_nothing(text):
    parts = chunking.oversized_splitter(text)
    assert "".join(parts) == text
    assert all(len(p) <= 3850 for p in parts)
    assert "".join(chunking.table_row_splitter(text)) == text


def test_overlapping_parts_cover_the_text():
    text = " ".join(f"w{i}" for i in range(800))
    parts = chunking.adaptive_splitter(text)
    assert all(len(p) <= 1000 for p in parts)
    assert parts[0] == text[: len(parts[0])] and text.endswith(parts[-1])
    assert {w for p in parts for w in p.split()} == set(text.split())


def test_cells_keep_escaped_pipes(spark):
    row = spark.createDataFrame([("| a \\| b | c |",)], "x string")
    assert row.select(structured.cells("x")).first()[0] == ["a | b", "c"]


def test_last_of_repeated_headers_wins(spark):
    row = spark.createDataFrame([(["a", "a", "b"], ["1", "2", "3"])], "h array<string>, r array<string>")
    assert row.select(structured.row_map(F.col("h"), F.col("r"))).first()[0] == {"a": "2", "b": "3"}


def test_corpus_keeps_tables_and_prose(spark):
    body = "# 재무상태표\n(단위 : 백만원)\n| 구분 | 당기 |\n| --- | --- |\n| 자산 | 100 |\n| - | - |\n\n회사는 2024년 3월 5일에 설립되었습니다."
    rows = corpus.build(spark.createDataFrame([("d1", body)], "doc_id string, body string")).orderBy("seq").collect()
    assert [r.chunk_type for r in rows] == ["text", "table_row", "text"] or [r.chunk_type for r in rows] == ["table_row", "text"]
    assert any("2024-03-05" in r.text for r in rows)
    assert {r.data_category for r in rows} == {"financial_statement"}


TABLES = {
    "numbered rows": ("| 항목 | 항목 | 값 |\n| --- | --- | --- |\n| 1. 계약금액 | 1. 계약금액 | 1,000 |\n| 2. 기간 | 시작일 | 2025-01-10 |\n| 3. 비고 | - | - |", [("1. 계약금액: 1000000", {"1. 계약금액": "1,000"}), ("2. 기간 > 시작일: 2025-01-10", {"2. 기간 > 시작일": "2025-01-10"})]),
    "period header": ("| 제 10 기 | 금액 |\n| --- | --- |\n| 이익 | **2,500** |", [("이익: 2500000", {"이익": "2,500"})]),
    "words of time": ("| 가 | 나 | 다 | 라 |\n| --- | --- | --- | --- |\n| 회계 | 부터 | 까지 | 2024년 |", [("회계 > 부터 > 까지: 2024년", {"회계 > 부터 > 까지": "2024년"})]),
    "labels": ("| x | y |\n| --- | --- |\n| 매출액 | 12억원 |\n| 설립일 | 1,5 |", [("설립일: 15000", {"설립일": "1,5"})]),
    "headers": ("| 이름 | 당기 | 전기 | 비율 |\n| --- | --- | --- | --- |\n| 갑 | 1,200 | - | 3.5 |\n| 을 | 7 |\n| - | - | - | - |", [(None, {"이름": "갑", "당기": "1,200", "전기": "-", "비율": "3.5"})]),
}


@pytest.mark.parametrize("name", TABLES)
def test_tables_are_read_down_or_across_in_their_unit(spark, name):
    table, want = TABLES[name]
    body = f"# 개요\n(단위 : 천원)\n(단위: 명)\n{table}"
    got = corpus.parse(spark.createDataFrame([("d", body), ("e", None)], "doc_id string, body string")).where("chunk_type = 'table_row'").orderBy("seq").collect()
    assert [r.structured_data for r in got] == [data for _, data in want]
    assert [r.text for r in got if name != "headers"] == [text for text, _ in want if text]
    assert {r.unit for r in got} == {"천원"} and all("1200000" in r.text for r in got if name == "headers")


def test_steps_of_the_corpus_plan_are_taken_once(spark):
    """A filter on the text of the blocks would be moved before the steps that make it, and repeat them all."""
    frame = spark.createDataFrame([("d", "text")], "doc_id string, body string")
    plan = corpus.build(frame).select("chunk_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace(" in line]


def test_texts_without_signs_of_dates_or_contents_are_left_as_they_are(spark):
    """Steps that are left out by a sign change nothing: texts put together of pieces of what the patterns find."""
    draw = random.Random(11)
    pieces = (
        *("목", "차", "페", "이", "지", "독립된", "감사인의", "감사보고서", "연", "결", "재", "무", "제", "표", "에", "대", "한", "ㆍ", "외부감사", "실시내용", "주석", "I.", "II. ", "가나", "(당)", "(", ")", "기"),
        *("【", "】", "-", "--", "---", "‥", "‥‥‥", "~", "12", "7", "2024", "2024년", "03월", "3월", "05일", ".", "2024.01.02", "2024주-01-02", "\n", "\n\n", "\r\n", "\t", " ", " ", "*", "**", ">", ":", "1. ", "a", "é", "제 54 기"),
    )
    rows = [("d", i, "".join(draw.choice(pieces) for _ in range(draw.randint(1, 9)))) for i in range(4000)]
    rows += [("d", 4000 + i, a + b + c) for i, (a, b, c) in enumerate((a, b, c) for a in ("", "x", "\n") for b in pieces for c in ("", "\n", "3"))]
    blocks = spark.createDataFrame(rows, "doc_id string, seq int, text string").repartition(2)
    text = F.col("text")
    every = text_functions.squeezed(text_functions.special_chars_removed(iso_dates(text_functions.path_simplified(text_functions.unmarked(text_functions.contents_removed(text))))))
    want = blocks.select("seq", every.alias("text"))
    assert sorted(map(tuple, corpus._plain(blocks).select("seq", "text").collect())) == sorted(map(tuple, want.collect()))
    wrong = (~text_functions.may_have_contents(text) & (text_functions.contents_removed(text) != text)) | (~may_have_dates(text) & (iso_dates(text) != text))
    assert blocks.where(wrong).count() == 0
    assert blocks.where(~text_functions.may_have_contents(text)).count() > 100 < blocks.where(~may_have_dates(text)).count()


def test_chunks_equal_a_plain_pass_over_each_document(spark):
    """Chunks of every document of the smallest tables, against windows written out as loops."""
    docs = {str(r.doc_id): r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    docs["md"] = "# A\n## B\nfirst paragraph here\n\n| x | 매출 | z | w |\n| - | - | - | - |\n| a | 1 | 2 | 3 |\n# C\n" + "long text. " * 200
    docs |= {"none": None, "empty": ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id string, body string")
    clean = corpus.normalise(corpus.parse(frame)).orderBy("doc_id", "seq").collect()
    want = []
    for doc in sorted({r.doc_id for r in clean}):
        parts = [(r.section_path, r.chunk_type, p, r.seq * 100_000 + i) for r in clean if r.doc_id == doc for i, p in enumerate(chunking.adaptive_splitter(r.text))]
        groups, n = [], {}
        for path, kind, text, seq in parts:
            if groups and groups[-1][:2] == [path, kind] and sum(len(t) // 4 for t in groups[-1][2]) + len(text) // 4 <= 7000:
                groups[-1][2].append(text)
            else:
                groups.append([path, kind, [text], seq])
        texts = ["\n".join(g[2]) for g in groups]
        for i, (path, kind, some, seq) in enumerate(groups):
            n[kind] = n.get(kind, -1) + 1
            name = "".join(c for c in path.split(" > ")[-1] if c.isalnum() or c == "_")[:10]
            beside = [" ".join(t.split(" ")[:100]) + ("..." if t.count(" ") >= 100 else "") for t in texts[max(0, i - 1) : i]], [" ".join(t.split(" ")[:100]) + ("..." if t.count(" ") >= 100 else "") for t in texts[i + 1 : i + 2]]
            want.append((doc, seq, f"{doc}_{kind}_{name}_{n[kind]:03d}", kind, len(some), texts[i], *(b[0] if b else None for b in beside)))
    got = corpus.build(frame).select("doc_id", "seq", "chunk_id", "chunk_type", "merged_count", "text", "prev_context", "next_context")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    again = corpus.chunk(corpus.normalise(corpus.parse(frame)).repartition(5, "seq")).select(got.columns)
    assert sorted(map(tuple, again.collect())) == sorted(want)
    assert "Exchange" not in corpus.build(frame)._jdf.queryExecution().executedPlan().toString()


def test_corpus_orders_texts_of_many_lines(spark):
    body = "\n".join(["The first paragraph."] + [""] * 29_998 + ["The last paragraph."])
    rows = corpus.build(spark.createDataFrame([("d1", body)], "doc_id string, body string")).orderBy("seq").collect()
    assert rows[0].text.startswith("The first") and rows[-1].text.endswith("The last paragraph.")
    blocks = spark.createDataFrame([("d1", i, f"s{i}", "text", f"block {i}") for i in (29_999, 0, 21_474, 21_475)], "doc_id string, seq int, section_path string, chunk_type string, text string")
    for merge in (True, False):
        rows = corpus.chunk(blocks, merge=merge).orderBy("seq").collect()
        assert [(r.seq, r.text) for r in rows] == [(i * 100_000, f"block {i}") for i in (0, 21_474, 21_475, 29_999)]


def test_train_test_split_ignores_partitioning(spark):
    rows = spark.range(500)
    one, two = (sft.train_test(df, "id").where("split = 'test'").select("id").toPandas().id.tolist() for df in (rows.repartition(1), rows.repartition(7)))
    assert sorted(one) == sorted(two)
    assert 20 < len(one) < 90


def test_terms_are_found_wherever_they_stand(spark):
    texts = {1: "the (주)회사 went up", 2: "xbar fooz !! yes", 3: "Alpha beta GAMMA delta", 4: "", 5: "a"}
    terms = ["(주)회사", "bar foo", "!!", "beta gamma", "alpha beta gamma", "a", "oo", "", "ta ga", "nothere at all here", "가"]
    docs, wanted = spark.createDataFrame(list(texts.items()), "k long, body string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = sorted((r.k, r.term) for r in joins.contained_terms(docs, wanted, key="k", text="body", term="term").collect())
    assert got == sorted((k, x) for k, b in texts.items() for x in terms if x and x.lower() in b.lower())
    far = joins.contained_terms(docs, wanted, key="k", text="body", term="term", broadcast_words=0)
    assert sorted((r.k, r.term) for r in far.collect()) == got
    reports = spark.createDataFrame([(1, "20200101", "(주)가나다 보고서")], "report_id long, day string, title string")
    files = spark.createDataFrame([("p", "x", "앞 (주)가나다 보고서 뒤")], "path string, name string, body string")
    assert joins.prefix_or_title(reports, files).first().matched_by == "title"


def test_an_alias_of_one_character_is_found(spark):
    questions = spark.createDataFrame([("오늘 갑 실적",)], "question string")
    companies = spark.createDataFrame([("갑", "000001", "갑")], "alias string, ticker string, corp_name string")
    assert joins.question_companies(questions, companies).count() == 1


def test_quiz_answers_are_never_broadcast(spark):
    """The answers look small to the planner, since rows are made by an explode; only the tree and the questions are broadcast."""
    answers = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (1, "b", 1), (2, "b", 1), (None, "a", 1), (3, "a", None)], "user_id long, question string, choice int")
    questions = spark.createDataFrame([("a", 1, "easy"), ("b", 1, "hard")], "question string, answer int, difficulty string")
    tree = spark.createDataFrame([(1, "a", True, "b"), (1, "a", False, "a")], "step int, current string, correct boolean, next string")
    got = quiz.walk(answers, tree, questions, "a", steps=2)
    want = [(None, 1, "a", False), (None, 2, "a", False), (1, 1, "a", True), (1, 2, "b", False), (1, 2, "b", True), (2, 1, "a", False), (2, 2, "a", False), (3, 1, "a", False), (3, 2, "a", False)]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Join" in line for line in plan) == sum(("strategy=broadcast" in line) or ("strategy=merge" in line) for line in plan) == 7


def test_a_text_is_not_repeated_beside_its_parts(spark):
    """A text of n characters used to leave its task n / 300 times over."""
    long = "some words, " * 200_000
    rows = spark.createDataFrame([(1, "x", long), (2, None, ""), (3, "z", None), (4, "w", "short")], "k int, note string, text string")
    out = chunking.split_rows(rows.coalesce(1), chunking.table_row_splitter)
    assert out.columns == ["k", "note", "part", "split_index", "total_splits"]
    got = sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[3]))
    assert "".join(r[2] for r in got if r[0] == 1) == long and {r[1] for r in got if r[0] == 1} == {"x"}
    n = len(got) - 3
    assert [r[3:] for r in got[:n]] == [(i, n) for i in range(n)]
    assert got[n:] == [(2, None, "", 0, 1), (3, "z", None, 0, 1), (4, "w", "short", 0, 1)]


@pytest.mark.parametrize("match", ["any", "all"])
@pytest.mark.parametrize("k", [None, 1, 3])
def test_words_are_counted_where_they_are_read(spark, monkeypatch, match, k):
    """As by joins, for equal scores, ids that repeat or are null, and many blocks; no word is shuffled."""
    monkeypatch.setattr(search, "BLOCK_CELLS", 20)
    rng = np.random.default_rng(5)
    texts = [(f"c{i}", " ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 6)))) for i in range(120)]
    asked = [(i % 12, " ".join(f"W{x}" for x in rng.integers(0, 9, rng.integers(0, 4)))) for i in range(14)] + [(None, "w1"), (99, None)]
    q = spark.createDataFrame(asked, "query_id int, query string")
    for more in ([], [("c7", "w1 w2"), ("c7", "w2 w3"), (None, "w1 w1"), (None, "w2 w1"), (None, None)]):
        chunks = spark.createDataFrame(texts + more, "chunk_id string, text string").repartition(3)
        one, two = (search.keyword_search(chunks, q, k=k, match=match, broadcast_words=n) for n in (500_000, 0))

        def rows(df):
            return sorted(((r.query_id, r.chunk_id, r.score) if k is None else tuple(r) for r in df.collect()), key=str)

        assert rows(one) == rows(two) and one.count() > 0
    one = search.keyword_search(spark.createDataFrame(texts, "chunk_id string, text string"), q, k=k, match=match)
    assert "Generate" not in (plan := one._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
    assert search.keyword_search(chunks, q.limit(0), k=k, match=match).count() == 0


def test_comparison_works_out_its_results_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    rows = spark.createDataFrame([(i // 2, f"m{i % 2}", float(i)) for i in range(10)], "query_id int, model string, similarity double").withColumn("model", counted("model"))
    assert sorted(map(tuple, writers.comparison(rows).collect())) == [(i, 2.0 * i, 2.0 * i + 1) for i in range(5)]
    assert seen.value == 10
