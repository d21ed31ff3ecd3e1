"""Retrieval and answer metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.operators import chat, context
from brinework.operators import metrics as M
from brinework.operators import search
from brinework.queries import ORACLES, query, table
from brinework.queries.retrieval import _CAND, _KW, _candidates, _ranked
from brinework.sources.writers import comparison


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: the texts found, in order, and expected keywords (the words of six letters and more of the item)."""
    found = _candidates(spark, sf_dir)
    words = search.tokens(F.col("query"))
    rows = found.groupBy("query_id", "query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content", "similarity"))), lambda s: F.struct(s["content"].alias("c"), s["similarity"].alias("s"))).alias("l"))
    expected = F.array_distinct(F.filter(words, lambda w: F.length(w) >= 6))
    return rows.select("query_id", "query", F.transform("l", lambda x: x["c"]).alias("texts"), F.transform("l", lambda x: x["s"]).alias("sims"), expected.alias("expected"))


_LISTS = (
    f"{_CAND}, l AS (SELECT query_id, query, list(lower(content) ORDER BY rank) AS t, list(sim ORDER BY rank) AS sims, any_value(list_distinct_kept) AS e FROM (SELECT *, "
    r"list_filter(regexp_extract_all(lower(query), '[\p{L}\p{N}]+'), lambda w: len(w) >= 6) AS ws, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: list_position(ws, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_kept FROM p) GROUP BY query_id, query), "
    "hh AS (SELECT *, list_transform(t, lambda x: len(list_filter(e, lambda k: contains(x, k)))) AS hits FROM l), "
    "g AS (SELECT *, list_transform(hits[1:5], lambda n: CASE WHEN n > 0 THEN 1 ELSE 0 END) AS rel FROM hh), "
    "m AS (SELECT query_id, CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(e, lambda k: len(list_filter(t[1:5], lambda x: contains(x, k))) > 0)) / len(e) END AS recall, "
    "list_sum(rel) / len(rel) AS \"precision\", coalesce(1.0::DOUBLE / list_position(list_transform(hits, lambda n: n > 0), true), 0.0::DOUBLE) AS mrr, "
    "coalesce(list_sum(list_transform(rel, lambda x, i: x / log2(i + 1))), 0.0::DOUBLE) AS dcg, list_sum(list_transform(range(1, CAST(list_sum(rel) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS idcg, "
    "CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(e, lambda k: contains(array_to_string(t, ' '), k))) / len(e) END AS coverage, list_avg(sims[1:5]) AS sim FROM g)"
)


@query(f"{_LISTS} SELECT query_id, round(recall, 6) AS recall, round(\"precision\", 6) AS \"precision\", round(mrr, 6) AS mrr, round(CASE WHEN coalesce(idcg, 0) = 0 THEN 0.0::DOUBLE ELSE dcg / idcg END, 6) AS ndcg, round(coverage, 6) AS coverage, round(sim, 5) AS avg_similarity FROM m")
def metric_recall_precision_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.slice("sims", 1, 5)
    values = {"recall": M.recall_at_k("texts", "expected"), "precision": M.precision_at_k("texts", "expected"), "mrr": M.reciprocal_rank("texts", "expected"), "ndcg": M.ndcg_at_k("texts", "expected"), "coverage": M.keyword_coverage("texts", "expected")}
    sim = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return _lists(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(k) for k, c in values.items()], F.round(sim, 5).alias("avg_similarity"))


_TURNS = "t AS (SELECT conv_id, turn, text AS q, answer AS a, next_q FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer, lead(text, 2) OVER w AS next_q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"
_KW2 = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[가-힣a-zA-Z0-9]+')), lambda w: len(w) >= 2 AND NOT list_contains(['" + "','".join(M.STOP_WORDS) + "'], w))"


@query(
    f"WITH {_TURNS}, k AS (SELECT *, {_KW2.format('a')} AS x, {_KW2.format('q')} AS y FROM t), s AS (SELECT *, len(list_intersect(x, y)) AS b FROM k), "
    "p AS (SELECT *, CASE WHEN len(x) = 0 THEN 0.0::DOUBLE ELSE b / len(x) END AS p, CASE WHEN len(y) = 0 THEN 0.0::DOUBLE ELSE b / len(y) END AS r FROM s) "
    r"SELECT conv_id, turn, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS f1, lower(regexp_replace(regexp_replace(trim(a), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')) = lower(regexp_replace(regexp_replace(trim(q), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')) AS exact FROM p"
)
def metric_keyword_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.keyword_f1("answer", "text")
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.round(f["precision"], 6).alias("p"), F.round(f["recall"], 6).alias("r"), F.round(f["f1"], 6).alias("f1"), M.exact_match("answer", "text").alias("exact"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir)
    return rows.select("query_id", M.recall_at_k("texts", "expected").alias("recall"), M.precision_at_k("texts", "expected").alias("precision"), M.reciprocal_rank("texts", "expected").alias("mrr"), M.keyword_coverage("texts", "expected").alias("coverage"))


@query(f"{_LISTS} SELECT query_id, round(70::DOUBLE * (0.3::DOUBLE * recall + 0.3::DOUBLE * \"precision\" + 0.2::DOUBLE * mrr + 0.2::DOUBLE * coverage) + 30::DOUBLE * (0.5::DOUBLE * recall), 4) AS score FROM m")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    c = F.col
    return _metrics(spark, sf_dir).select("query_id", F.round(M.overall_score(c("recall"), c("precision"), c("mrr"), c("coverage"), c("recall"), no, no), 4).alias("score"))


@query(f"{_LISTS}, u AS (SELECT 'recall' AS metric, recall AS v FROM m UNION ALL SELECT 'precision', \"precision\" FROM m UNION ALL SELECT 'mrr', mrr FROM m) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM u GROUP BY metric")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.summary(_metrics(spark, sf_dir), ["recall", "precision", "mrr"])
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


def _words_sql(c: str, least: int) -> str:
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda w: len(w) >= {least})"


@query(
    f"WITH {_TURNS}, s AS (SELECT *, list_filter(string_split(a, '.'), lambda x: trim(x) <> '') AS ss, lower(q) AS ctx, list_distinct({_words_sql('q', 2)}) AS qw FROM t) "
    f"SELECT conv_id, turn, round(CASE WHEN len(ss) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(ss, lambda x: len({_words_sql('x', 3)}) > 0 AND len(list_filter({_words_sql('x', 3)}, lambda y: contains(ctx, y))) * 2 >= len({_words_sql('x', 3)}))) / len(ss) END, 6) AS faithfulness, "
    "round(CASE WHEN len(qw) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(qw, lambda w: contains(lower(a), w))) / len(qw) END, 6) AS relevancy, "
    "CASE WHEN len(qw) > 0 AND len(list_filter(qw, lambda w: contains(lower(a), w))) * 10 >= len(qw) * 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS context_precision, "
    "round(CASE WHEN len(qw) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(qw, lambda w: contains(lower(a), w))) / len(qw) END, 6) AS context_recall FROM s"
)
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns(table(spark, sf_dir, "conversations"))
    q, a = F.array("text"), F.array("answer")
    values = {"faithfulness": M.faithfulness("answer", q), "relevancy": M.answer_relevancy("text", "answer"), "context_precision": M.context_precision("text", a), "context_recall": M.context_recall("text", a)}
    return rows.select("conv_id", "turn", *[F.round(c, 6).alias(k) for k, c in values.items()])


_RATED = f"WITH am AS ({ORACLES['answer_metrics']}), {_TURNS}, u AS (SELECT conv_id, turn, q, a, CASE WHEN turn % 3 = 0 THEN 'failed' END AS error, faithfulness AS f, relevancy AS v, context_precision AS p, CASE WHEN turn > 0 THEN context_recall END AS r FROM t JOIN am USING (conv_id, turn))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pipeline runs, every third message as a failed one, with their answer metrics."""
    rows = chat.turns(table(spark, sf_dir, "conversations")).join(answer_metrics(spark, sf_dir), ["conv_id", "turn"])
    one, c = F.lit(1), F.col
    valid = M.validity(one, one, c("text"), c("answer"), one, F.lit(0.9))["valid"]
    return rows.select(
        (c("conv_id") % 5).alias("part"), "conv_id", "turn", F.when(c("turn") % 3 == 0, "failed").alias("error"), valid.alias("valid"), context.grounded("answer").alias("grounded"), F.length("text").alias("retrieved"), F.regexp_count("answer", F.lit("a")).alias("citations"),
        F.length("answer").alias("time_ms"), "faithfulness", c("relevancy").alias("answer_relevancy"), "context_precision", F.when(c("turn") > 0, c("context_recall")).alias("context_recall"),
    )


@query(
    f"{_RATED} SELECT conv_id % 5 AS part, count(*) AS runs, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NULL AND length(q) >= 50 AND length(a) >= 10 AND NOT regexp_matches(lower(a), 'error|오류')) AS valid, count(*) FILTER (error IS NULL AND contains(a, '[ref:')) AS grounded, "
    "round(coalesce(avg(length(q)) FILTER (error IS NULL), 0), 6) AS avg_retrieved, round(coalesce(avg(length(a) - length(replace(a, 'a', ''))) FILTER (error IS NULL), 0), 6) AS avg_citations, round(coalesce(avg(length(a)) FILTER (error IS NULL), 0), 6) AS avg_time_ms, "
    "round(coalesce(avg(f) FILTER (error IS NULL), 0), 5) AS avg_faithfulness, round(coalesce(avg(v) FILTER (error IS NULL), 0), 5) AS avg_answer_relevancy, round(coalesce(avg(p) FILTER (error IS NULL), 0), 5) AS avg_context_precision, round(avg(r) FILTER (error IS NULL), 5) AS avg_context_recall FROM u GROUP BY 1"
)
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = {"retrieved": 6, "citations": 6, "time_ms": 6, "faithfulness": 5, "answer_relevancy": 5, "context_precision": 5, "context_recall": 5}
    return M.pipeline_summary(_runs(spark, sf_dir), ["part"]).withColumns({f"avg_{k}": F.round(f"avg_{k}", n) for k, n in digits.items()})


@query(
    f"{_RATED} SELECT conv_id % 5 AS part, count(*) AS total_queries, count(*) FILTER (error IS NULL) AS successful_queries, count(*) FILTER (error IS NOT NULL) AS failed_queries, coalesce(sum(length(a)) FILTER (error IS NULL), 0)::DOUBLE AS total_time_ms, round(coalesce(avg(length(a)) FILTER (error IS NULL), 0), 6) AS avg_time_ms, "
    "round(coalesce(avg(length(q)) FILTER (error IS NULL), 0), 6) AS avg_documents_per_query, round(coalesce(avg(f) FILTER (error IS NULL), 0), 5) AS avg_similarity FROM u GROUP BY 1"
)
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.timing_summary(_runs(spark, sf_dir), ["part"], found="retrieved", similarity="faithfulness")
    return out.withColumns({"avg_time_ms": F.round("avg_time_ms", 6), "avg_documents_per_query": F.round("avg_documents_per_query", 6), "avg_similarity": F.round("avg_similarity", 5)})


@query(f"WITH am AS ({ORACLES['answer_metrics']}) SELECT conv_id || '_' || turn AS query_id, metric, value FROM (SELECT conv_id, turn, unnest(['faithfulness', 'relevancy']) AS metric, unnest([faithfulness, relevancy]) AS value FROM am) WHERE value IS NULL OR value < 0.5")
def metric_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer_metrics(spark, sf_dir).withColumn("query_id", F.concat_ws("_", "conv_id", "turn"))
    return M.failures(rows, ["faithfulness", "relevancy"])


@query("SELECT lang AS method, round(avg(length(text)), 4) AS avg_seconds, round(avg(quality), 6) AS avg_quality, count(DISTINCT doc_id) AS n_queries, avg(length(text)) = min(avg(length(text))) OVER () AS fastest, row_number() OVER (ORDER BY avg(quality) DESC, lang) = 1 AS best FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def method_compare_argbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("method"), F.length("text").alias("seconds"), "quality", F.col("doc_id").alias("query_id"))
    return M.best_methods(rows).withColumns({"avg_seconds": F.round("avg_seconds", 4), "avg_quality": F.round("avg_quality", 6)})


@query(
    f"WITH {_TURNS} SELECT conv_id, turn, length(q) >= 50 AND length(a) >= 10 AND NOT regexp_matches(lower(a), 'error|오류') AS valid, CAST((CASE WHEN length(q) < 50 THEN 1 ELSE 0 END) + (CASE WHEN length(a) < 10 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(lower(a), 'error|오류') THEN 1 ELSE 0 END) AS INT) AS n_issues FROM t"
)
def pipeline_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    v = M.validity(one, one, F.col("text"), F.col("answer"), one, F.lit(0.9))
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", v["valid"].alias("valid"), F.size(v["issues"]).alias("n_issues"))


_KEYS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[가-힣a-zA-Z0-9]+')), lambda w: len(w) >= 2)"


@query(f"WITH {_TURNS}, k AS (SELECT *, {_KEYS.format('q')} AS x, {_KEYS.format('a')} AS y FROM t), o AS (SELECT *, CASE WHEN len(x) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y)) / len(x) END AS o FROM k) SELECT conv_id, turn, round(least(1.0::DOUBLE, 0.25::DOUBLE * o + 0.2::DOUBLE * (0.6::DOUBLE * o + 0.4::DOUBLE * 0.5::DOUBLE) + 0.2::DOUBLE * o + 0.05::DOUBLE * 0.5::DOUBLE), 5) AS score FROM o")
def composite_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, half, zero = M.keyword_overlap("text", "answer"), F.lit(0.5), F.lit(0.0)
    score = M.understanding(o, M.coherence(o, half), o, zero, zero, half)
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.round(score, 5).alias("score"))


_MODELS = f"WITH {_KW}, r AS (SELECT query_id, CASE rank % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS model, (rank + 1) // 2 AS rank, score FROM kw WHERE rank <= 10)"


@query(f"{_MODELS}, e AS (SELECT model, query_id, avg(score) AS a, max(score) FILTER (rank = 1) AS t1, avg(score) FILTER (rank <= 3) AS t3 FROM r GROUP BY ALL) SELECT model, count(*) AS n_queries, round(avg(a), 6) AS avg_similarity, round(avg(t1), 6) AS avg_top1, round(avg(t3), 6) AS avg_top3 FROM e GROUP BY model")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.compare_models(_models(spark, sf_dir)).select("model", "n_queries", *[F.round(c, 6).alias(c) for c in ("avg_similarity", "avg_top1", "avg_top3")])


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 10).select("query_id", F.when(F.col("rank") % 2 == 0, "even").otherwise("odd").alias("model"), F.floor((F.col("rank") + 1) / 2).alias("rank"), F.col("score").alias("similarity"))


@query(f"{_MODELS} SELECT query_id, round(max(score) FILTER (model = 'even' AND rank = 1), 6) AS even, round(max(score) FILTER (model = 'odd' AND rank = 1), 6) AS odd FROM r GROUP BY query_id")
def model_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _models(spark, sf_dir).where("rank = 1").withColumn("similarity", F.round("similarity", 6))
    return comparison(rows)
