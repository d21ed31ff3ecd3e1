"""Packing results into a budget, formatting, citations and guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.text import first_filled, sentences, squeezed, token_estimate

#: Retrieval parameters of each user level (k, rerank_n, context tokens).
LEVELS = {"beginner": (3, 3, 2000), "intermediate": (4, 4, 2600), "advanced": (5, 6, 3500)}
#: The note that guarded answers end with, and words that make it needless.
DISCLAIMER = "\n\n※ 본 답변은 정보 제공 목적이며 투자 권유가 아닙니다."
DISCLAIMED = "투자 권유가 아니다"
#: What stands around a preview when no answer was generated, and instead of one.
NO_ANSWER = "죄송합니다. 모델이 답변을 생성하지 못했습니다. 다음 참고 내용을 확인해 주세요:\n\n```markdown\n"
NO_CONTEXT = "죄송합니다. 현재 질문에 대한 답변을 생성하지 못했습니다. 잠시 후 다시 시도해 주세요."
#: The rules of every answer, how to speak to each level, and the structure of its answer.
RULES = (
    "너는 금융 리서치 Q&A 보조원이다. 제공 컨텍스트 밖 추론 금지.\n"
    "수치·날짜는 원문 근거로 정확히 재현하라.\n"
    "반드시 답변 끝에 [ref: report_id, date]를 포함하고 필요 시 URL도 제시하라.\n"
    "이 답변은 정보 제공 목적이며 투자 권유가 아니다.\n"
)
MANNERS = {
    "beginner": "\n  사용자는 투자 초보자입니다.\n  어려운 용어를 쓰지 말고, 예시를 들어 쉽게 설명하세요.\n  ",
    "intermediate": "\n  사용자는 기본적인 투자 용어를 알고 있습니다.\n  주요 수치(매출, 이익률 등)는 포함하되 설명은 간결하게 하세요.\n  ",
    "advanced": "\n  사용자는 재무제표와 투자지표를 이해합니다.\n  구체적인 수치 비교와 추세 해석, 문서 근거를 함께 제시하세요.\n  ",
}
STRUCTURES = {
    "beginner": "①핵심 요약(쉬운 용어) ②간단 예시 ③근거",
    "intermediate": "①핵심 요약 ②핵심 수치·포인트 ③근거",
    "advanced": "①핵심 결론 ②수치 비교/추세 해석 ③리스크·가정 ④근거",
}
#: The opening, the name of the query, the heading and the closing of a context by purpose.
PURPOSES = {
    "qa": ("다음 질문에 답하기 위해 관련 문서들을 검색했습니다:", "질문", "참고 문서들", "위 문서들을 참고하여 질문에 정확하고 상세하게 답변해주세요."),
    "summarization": ("다음 주제에 대한 문서들을 요약해주세요:", "주제", "문서들", "위 문서들을 종합하여 핵심 내용을 요약해주세요."),
}
CITATION_FIELDS = ("report_id", "chunk_id", "title", "date", "url", "corp_name", "document_name", "rcept_dt")


def pack(results: DataFrame, *, budget: int = 4000, max_documents: int = 5, least: int = 100, order: list[str | Column] | None = None, query_id: str = "query_id", content: str = "content") -> DataFrame:
    """The first documents of each query whose words fit the budget.

    The document that no longer fits is cut to the rest if more than ``least``
    words of room remain; everything after it is left out.  Columns ``packed``
    (text), ``words`` and ``cut`` are added, ``rank`` is the place in the context.
    """
    order = order or ["rank"]
    w = Window.partitionBy(query_id).orderBy(*order)
    parts = F.filter(F.split(F.coalesce(F.col(content), F.lit("")), r"\s+"), lambda x: x != "")
    rows = results.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= max_documents).withColumn("_words", parts).withColumn("words", F.size("_words"))
    before = F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - F.col("_before")
    rows = rows.withColumn("_before", before).where(F.col("_before") < budget)
    fits = F.col("words") <= room
    rows = rows.where(fits | (room > least)).withColumn("cut", ~fits)
    text = F.when(fits, F.col(content)).otherwise(F.concat(F.concat_ws(" ", F.slice("_words", F.lit(1), room.cast("int"))), F.lit("...")))
    return rows.withColumn("packed", text).withColumn("words", F.least(F.col("words"), room).cast("int")).withColumn("rank", F.col("_at")).drop("_at", "_words", "_before")


def _heading(style: str) -> Column:
    n, title = F.col("rank").cast("string"), first_filled("title", "document_name", "chunk_id")
    company, day = first_filled("corp_name"), first_filled("date", "rcept_dt")
    facts = F.concat_ws(", ", F.nullif(company, F.lit("")), F.nullif(day, F.lit("")))
    facts = F.when(facts != "", F.concat(F.lit(" ("), facts, F.lit(")"))).otherwise("")
    if style == "markdown":
        return F.concat(F.lit("### "), n, F.lit(". "), title, facts)
    if style == "badged":
        badge = F.when(F.col("similarity") > 0.85, "[높은 관련성] ").when(F.col("similarity") > 0.75, "[관련] ").otherwise("")
        return F.concat(badge, F.lit("[문서 "), n, F.lit("] "), title, facts)
    return F.concat(F.lit("[문서 "), n, F.lit("] "), title, facts)


def formatted(packed: DataFrame, *, style: str = "prompt", query_id: str = "query_id") -> DataFrame:
    """(query_id, context, n_documents, avg_similarity, tokens), documents in rank order.

    style: prompt, markdown, badged (relevance marks), conversational, structured
    or json.  Absent columns title, document_name, corp_name, date and rcept_dt count as empty.
    """
    for c in ("title", "document_name", "corp_name", "date", "rcept_dt"):
        if c not in packed.columns:
            packed = packed.withColumn(c, F.lit(""))
    if style in ("prompt", "markdown", "badged"):
        body, glue = F.concat(_heading(style), F.lit("\n"), F.col("packed")), "\n\n"
    elif style == "conversational":
        body, glue = F.concat(first_filled("title", "document_name", "chunk_id"), F.lit("에 따르면, "), F.col("packed")), "\n\n"
    elif style == "structured":
        body, glue = F.concat(F.lit("문서: "), F.col("rank").cast("string"), F.lit("\n출처: "), first_filled("title", "document_name", "chunk_id"), F.lit("\n내용: "), F.col("packed")), "\n---\n"
    elif style == "json":
        body, glue = F.to_json(F.struct("rank", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("packed").alias("content"))), ","
    else:
        raise ValueError(f"unknown style {style!r}")
    rows = packed.withColumn("_line", F.struct(F.col("rank").alias("r"), body.alias("b")))
    out = rows.groupBy(query_id).agg(F.sort_array(F.collect_list("_line")).alias("_l"), F.count("*").alias("n_documents"), F.avg("similarity").alias("avg_similarity"))
    text = F.array_join(F.transform("_l", lambda x: x["b"]), glue)
    if style == "json":
        text = F.concat(F.lit("["), text, F.lit("]"))
    return out.select(query_id, text.alias("context"), "n_documents", "avg_similarity", token_estimate(text, per_token=1.5).alias("tokens"))


def purpose_context(results: DataFrame, purpose: str = "general", *, most: int = 3, query_id: str = "query_id", query: str = "query", content: str = "content") -> DataFrame:
    """(query_id, context) for ``qa`` (the first ``most`` results with their similarity) or
    ``summarization`` (all results), texts framed by fixed sentences; ``general`` is :func:`formatted`.

    Results are taken in rank order, equal ranks by text; a null text counts as ''.
    """
    if purpose == "general":
        packed = results if "packed" in results.columns else results.withColumn("packed", F.col(content))
        return formatted(packed, query_id=query_id).select(query_id, "context")
    if purpose not in PURPOSES:
        raise ValueError(f"unknown purpose {purpose!r}")
    lead, label, heading, closing = PURPOSES[purpose]
    w = Window.partitionBy(query_id).orderBy("rank", content)
    rows = results.withColumn("_n", F.row_number().over(w))
    n, text = F.col("_n").cast("string"), F.coalesce(F.col(content), F.lit(""))
    if purpose == "qa":
        rows = rows.where(F.col("_n") <= most)
        body = F.concat(n, F.lit(". (유사도: "), F.format_string("%.3f", F.coalesce(F.col("similarity").cast("double"), F.lit(0.0))), F.lit(") "), text, F.lit("\n\n"))
    else:
        body = F.concat(F.lit("[문서 "), n, F.lit("]\n"), text, F.lit("\n\n"))
    found = rows.groupBy(query_id).agg(F.first(query).alias("_q"), F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), body.alias("b")))).alias("_l"))
    start = F.concat(F.lit(f"{lead}\n\n{label}: "), F.coalesce(F.col("_q"), F.lit("")), F.lit(f"\n\n{heading}:\n"))
    return found.select(query_id, F.concat(start, F.array_join(F.transform("_l", lambda x: x["b"]), ""), F.lit(closing)).alias("context"))


def system_prompt(level: str | Column) -> Column:
    """The rules of an answer and how to speak to a user of the level; unknown levels count as beginner."""
    return F.concat(F.lit(RULES + "\n"), _by_level(level, MANNERS, "beginner"))


def user_prompt(question: str | Column, context: str | Column, level: str | Column) -> Column:
    """Question, context and the answer's structure for the level; unknown levels count as intermediate."""
    q, c = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (question, context))
    return F.concat(F.lit("질문: "), q, F.lit("\n\n[컨텍스트]\n"), c, F.lit("\n\n요구 형식: "), _by_level(level, STRUCTURES, "intermediate"))


def _by_level(level: str | Column, texts: dict[str, str], otherwise: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(level) if isinstance(level, str) else level), F.lit(texts[otherwise]))


def policy_facts(c: str | Column) -> Column:
    """struct<rates, limits, conditions> of the sentences about rates, limits and conditions."""
    parts = F.transform(F.split(F.col(c) if isinstance(c, str) else c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))

    def some(pattern: str) -> Column:
        return F.filter(parts, lambda s: s.rlike(pattern))

    return F.struct(some(r"\d+(\.\d+)?\s*%|금리|이율").alias("rates"), some(r"한도|최대|이내|\d+\s*(억|만)?원").alias("limits"), some("조건|대상|자격|요건").alias("conditions"))


def citations(results: DataFrame, *, query_id: str = "query_id") -> DataFrame:
    """One row per query and (report_id, chunk_id), the first in rank order, with its eight fields."""
    for c in CITATION_FIELDS:
        if c not in results.columns:
            results = results.withColumn(c, F.lit(""))
    w = Window.partitionBy(query_id, "report_id", "chunk_id").orderBy("rank")
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(query_id, "rank", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CITATION_FIELDS])


def citation_list(rows: DataFrame, *, query_id: str = "query_id") -> DataFrame:
    """The citations of each query as numbered Markdown lines."""
    w = Window.partitionBy(query_id).orderBy("rank")
    line = F.concat(F.row_number().over(w).cast("string"), F.lit(". "), first_filled("title", "document_name", "chunk_id"), F.when(F.col("date") != "", F.concat(F.lit(" ("), F.col("date"), F.lit(")"))).otherwise(""))
    lines = rows.withColumn("_l", F.struct("rank", line.alias("b")))
    return lines.groupBy(query_id).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_l")), lambda x: x["b"]), "\n").alias("citation_list"))


def grounded(answer: str | Column) -> Column:
    return F.coalesce(F.contains(F.col(answer) if isinstance(answer, str) else answer, F.lit("[ref:")), F.lit(False))


def guarded(answer: str | Column, note: str = DISCLAIMER) -> Column:
    """The answer with the note at its end, once; an answer that says so itself stays."""
    c = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    return F.when(F.contains(c, F.lit(DISCLAIMED)) | F.contains(c, F.lit(note)), c).otherwise(F.concat(c, F.lit(note)))


def fallback_answer(context: str | Column, *, most: int = 3, limit: int = 600) -> Column:
    """What is said without a generated answer: the context's first sentences, at most ``limit`` characters, as a preview."""
    c = F.col(context) if isinstance(context, str) else context
    preview = F.trim(F.left(sentences(squeezed(F.coalesce(c, F.lit(""))), most), F.lit(limit)))
    return F.when(preview == "", F.lit(NO_CONTEXT)).otherwise(F.concat(F.lit(NO_ANSWER), preview, F.lit("\n```")))


def level_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in LEVELS.items()], "level string, top_k int, rerank_n int, max_context int")
