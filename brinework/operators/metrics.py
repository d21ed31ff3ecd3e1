"""Retrieval, answer and pipeline metrics over ARRAY columns, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.functions.text import STOP_WORDS, _col, keywords, normalised

#: Fixed value: a ground truth with this mark is a placeholder.
PLACEHOLDER = "XX"
#: Entity patterns of the composite score.
ENTITY_PATTERNS = ("[가-힣]+시", "[가-힣]+구", "[가-힣]+동", "[가-힣]+은행", "[가-힣]+공사", "[가-힣]+센터", r"\d+억원", r"\d+만원", r"\d+%", r"\d+년", r"\d+개월")
#: Words of the housing-finance domain.
DOMAIN_WORDS = (
    "임차보증금", "이자지원", "대출한도", "소득기준", "신혼부부", "전세", "월세", "보증서", "금융공사",
    "주택금융", "연소득", "무주택자", "세대주", "혼인관계", "가족관계", "주민등록",
)



def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _lower(a: Column) -> Column:
    return F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))


def _relevance(texts: Column, expected: Column) -> Column:
    """Number of expected keywords in each text."""
    return F.transform(_lower(texts), lambda t: F.size(F.filter(_lower(expected), lambda k: F.contains(t, k))))


def recall_at_k(texts: str | Column, expected: str | Column, k: int = 5) -> Column:
    """Share of the distinct expected keywords that the first k texts hold."""
    top, want = F.slice(_lower(_col(texts)), 1, k), F.array_distinct(_lower(_col(expected)))
    return _share(F.size(F.filter(want, lambda w: F.exists(top, lambda t: F.contains(t, w)))), F.size(F.coalesce(_col(expected), F.array().cast("array<string>"))))


def precision_at_k(texts: str | Column, expected: str | Column, k: int = 5) -> Column:
    """Share of the first k texts that hold an expected keyword."""
    top = F.slice(_lower(_col(texts)), 1, k)
    return _share(F.size(F.filter(_relevance(top, _col(expected)), lambda n: n > 0)), F.size(top))


def reciprocal_rank(texts: str | Column, expected: str | Column) -> Column:
    """1 / place of the first text with an expected keyword, over the whole list; 0 without one."""
    hits = F.transform(_relevance(_col(texts), _col(expected)), lambda n: (n > 0).cast("int"))
    at = F.array_position(hits, 1)
    return F.when(F.coalesce(at, F.lit(0)) == 0, 0.0).otherwise(1.0 / at)


def ndcg_at_k(texts: str | Column, expected: str | Column, k: int = 5) -> Column:
    """Discounted gain of binary relevance over its best order."""
    hits = F.transform(_relevance(F.slice(_lower(_col(texts)), 1, k), _col(expected)), lambda n: (n > 0).cast("int"))

    def gain(a: Column) -> Column:
        return F.aggregate(F.transform(a, lambda x, i: x / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x)

    best = gain(F.reverse(F.array_sort(hits)))
    return F.when(best == 0, 0.0).otherwise(gain(hits) / best)


def keyword_coverage(texts: str | Column, expected: str | Column) -> Column:
    """Share of the expected keywords in all texts joined by blanks."""
    joined, want = F.concat_ws(" ", _lower(_col(texts))), _lower(_col(expected))
    return _share(F.size(F.filter(want, lambda w: F.contains(joined, w))), F.size(want))


def exact_match(answer: str | Column, truth: str | Column) -> Column:
    return F.coalesce(normalised(answer) == normalised(truth), F.lit(False))


def contains_truth(answer: str | Column, truth: str | Column) -> Column:
    """Whether the answer holds the ground truth; placeholders and empty truths don't count."""
    t = normalised(truth)
    return F.coalesce(~F.contains(_col(truth), F.lit(PLACEHOLDER)) & (t != "") & F.contains(normalised(answer), t), F.lit(False))


def keyword_f1(answer: str | Column, truth: str | Column) -> Column:
    """struct<precision, recall, f1> of the sets of keywords without stop words."""
    a, t = F.array_distinct(keywords(answer, stop_words=STOP_WORDS)), F.array_distinct(keywords(truth, stop_words=STOP_WORDS))
    both = F.size(F.array_intersect(a, t))
    p, r = _share(both, F.size(a)), _share(both, F.size(t))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def overall_score(recall: Column, precision: Column, mrr: Column, coverage: Column, f1: Column, contained: Column, exact: Column) -> Column:
    """0 to 100: 70 for retrieval, 30 for the answer."""
    return 70 * (0.3 * recall + 0.3 * precision + 0.2 * mrr + 0.2 * coverage) + 30 * (0.5 * f1 + 0.3 * contained.cast("double") + 0.2 * exact.cast("double"))


def words(c: str | Column, least: int) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= least)


def faithfulness(answer: str | Column, contexts: str | Column) -> Column:
    """Share of the answer's sentences of whose words (3 or more characters) half or more are in the contexts."""
    parts = F.filter(F.split(F.coalesce(_col(answer), F.lit("")), r"\."), lambda s: F.trim(s) != "")
    joined = F.concat_ws(" ", _lower(_col(contexts)))

    def supported(s: Column) -> Column:
        w = words(s, 3)
        return (F.size(w) > 0) & (F.size(F.filter(w, lambda x: F.contains(joined, x))) * 2 >= F.size(w))

    return _share(F.size(F.filter(parts, supported)), F.size(parts))


def answer_relevancy(question: str | Column, answer: str | Column) -> Column:
    """Share of the question's distinct words in the answer."""
    want, text = F.array_distinct(words(question, 2)), F.lower(F.coalesce(_col(answer), F.lit("")))
    return _share(F.size(F.filter(want, lambda w: F.contains(text, w))), F.size(want))


def context_precision(question: str | Column, contexts: str | Column) -> Column:
    """Share of the contexts that hold 30 % of the question's distinct words."""
    want, texts = F.array_distinct(words(question, 2)), _lower(_col(contexts))
    good = F.filter(texts, lambda t: (F.size(want) > 0) & (F.size(F.filter(want, lambda w: F.contains(t, w))) * 10 >= F.size(want) * 3))
    return _share(F.size(good), F.size(texts))


def context_recall(truth: str | Column, contexts: str | Column) -> Column:
    """Share of the ground truth's distinct words in the contexts; null without a ground truth."""
    want, joined = F.array_distinct(words(truth, 2)), F.concat_ws(" ", _lower(_col(contexts)))
    return F.when(F.coalesce(_col(truth), F.lit("")) == "", F.lit(None).cast("double")).otherwise(_share(F.size(F.filter(want, lambda w: F.contains(joined, w))), F.size(want)))


def mean_of(*cols: str | Column) -> Column:
    """Mean of the values that aren't null; null if all are."""
    some = F.filter(F.array(*[_col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda acc, x: acc + x) / F.size(some))


def summary(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows (metric, n, mean, std, min, max), nulls left out, population deviation; ``by`` adds keys."""
    keys = by or []
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(*keys, "m.*")
    return long.groupBy(*keys, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def validity(retrieved: Column, with_metadata: Column, context: Column, answer: Column, cited: Column, average: Column) -> Column:
    """struct<valid, issues, warnings> of one pipeline run."""
    issues = F.filter(
        F.array(
            F.when(F.coalesce(retrieved, F.lit(0)) == 0, "no documents"),
            F.when(F.coalesce(with_metadata, F.lit(0)) < F.coalesce(retrieved, F.lit(0)), "metadata missing"),
            F.when(F.length(F.coalesce(context, F.lit(""))) < 50, "context too short"),
            F.when(F.length(F.coalesce(answer, F.lit(""))) < 10, "answer too short"),
            F.when(F.lower(F.coalesce(answer, F.lit(""))).rlike("error|오류"), "answer is an error"),
            F.when(F.coalesce(cited, F.lit(0)) == 0, "no citations"),
        ),
        lambda x: x.isNotNull(),
    )
    warnings = F.filter(F.array(F.when(average < 0.3, "low similarity")), lambda x: x.isNotNull())
    return F.struct((F.size(issues) == 0).alias("valid"), issues.alias("issues"), warnings.alias("warnings"))


def entity_density(c: str | Column) -> Column:
    """Matches of the entity patterns per 1000 characters, at most 1."""
    c = F.coalesce(_col(c), F.lit(""))
    n = sum((F.regexp_count(c, F.lit(p)) for p in ENTITY_PATTERNS[1:]), F.regexp_count(c, F.lit(ENTITY_PATTERNS[0])))
    return F.least(F.lit(1.0), F.when(F.length(c) == 0, 0.0).otherwise(n * 1000.0 / F.length(c)))


def domain_share(c: str | Column, words: tuple[str, ...] = DOMAIN_WORDS) -> Column:
    """Share of the domain's words in the text."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))) / F.lit(float(len(words)))


def keyword_overlap(a: str | Column, b: str | Column) -> Column:
    """Share of the distinct keywords of ``a`` that ``b`` has too; its precision and recall are one value."""
    x, y = F.array_distinct(keywords(a)), F.array_distinct(keywords(b))
    return _share(F.size(F.array_intersect(x, y)), F.size(x))


def understanding(f1: Column, coherence: Column, relevance: Column, entities: Column, domain: Column, similarity: Column) -> Column:
    """Composite of six scores with fixed weights, at most 1."""
    return F.least(F.lit(1.0), 0.25 * f1 + 0.2 * coherence + 0.2 * relevance + 0.15 * entities + 0.15 * domain + 0.05 * similarity)


def coherence(overlap: Column, similarity: Column) -> Column:
    return 0.6 * overlap + 0.4 * similarity


def best_methods(runs: DataFrame, *, method: str = "method", seconds: str = "seconds", quality: str = "quality", query_id: str = "query_id") -> DataFrame:
    """Means of each method, and whether it is the fastest and the best."""
    means = runs.groupBy(method).agg(F.avg(seconds).alias("avg_seconds"), F.avg(quality).alias("avg_quality"), F.countDistinct(query_id).alias("n_queries"))
    best = means.agg(F.min_by(method, F.struct("avg_seconds", method)).alias("_fast"), F.min_by(method, F.struct(-F.col("avg_quality"), F.col(method))).alias("_good"))
    return means.join(F.broadcast(best)).select(method, "avg_seconds", "avg_quality", "n_queries", (F.col(method) == F.col("_fast")).alias("fastest"), (F.col(method) == F.col("_good")).alias("best"))


def compare_models(results: DataFrame, *, model: str = "model", query_id: str = "query_id", similarity: str = "similarity", rank: str = "rank") -> DataFrame:
    """Per model: queries, mean similarity, mean of the first and of the first three results."""
    each = results.groupBy(model, query_id).agg(F.avg(similarity).alias("a"), F.max(F.when(F.col(rank) == 1, F.col(similarity))).alias("t1"), F.avg(F.when(F.col(rank) <= 3, F.col(similarity))).alias("t3"))
    return each.groupBy(model).agg(F.count("*").alias("n_queries"), F.avg("a").alias("avg_similarity"), F.avg("t1").alias("avg_top1"), F.avg("t3").alias("avg_top3"))


def timing_summary(runs: DataFrame, by: list[str] | None = None, *, error: str = "error", ms: str = "time_ms", found: str = "documents_found", similarity: str = "avg_similarity") -> DataFrame:
    """Counts of all, successful and failed queries, and totals and means over the successful ones (0 without any).

    A query failed if its ``error`` isn't null; a successful query without a value counts as 0.
    """
    ok = F.col(error).isNull()

    def of(c: str) -> Column:
        return F.when(ok, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(of(c)), F.lit(0.0))

    return runs.groupBy(*(by or [])).agg(
        F.count("*").alias("total_queries"),
        F.count_if(ok).alias("successful_queries"),
        F.count_if(~ok).alias("failed_queries"),
        F.coalesce(F.sum(of(ms)), F.lit(0.0)).alias("total_time_ms"),
        mean(ms).alias("avg_time_ms"),
        mean(found).alias("avg_documents_per_query"),
        mean(similarity).alias("avg_similarity"),
    )


def pipeline_summary(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many runs succeeded, were valid and grounded, and means over the successful ones.

    ``runs``: error, valid, grounded, retrieved, citations, time_ms, faithfulness,
    answer_relevancy, context_precision, context_recall.  A null counts as 0 or
    false, but runs without a context_recall are left out of its mean, which is
    null without any.
    """
    ok = F.col("error").isNull()

    def yes(c: str) -> Column:
        return F.count_if(ok & F.coalesce(F.col(c), F.lit(False)))

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(F.when(ok, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), F.lit(0.0))

    means = ("retrieved", "citations", "time_ms", "faithfulness", "answer_relevancy", "context_precision")
    return runs.groupBy(*(by or [])).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successful"), yes("valid").alias("valid"), yes("grounded").alias("grounded"),
        *[mean(c).alias(f"avg_{c}") for c in means],
        F.avg(F.when(ok, F.col("context_recall").cast("double"))).alias("avg_context_recall"),
    )


def failures(results: DataFrame, metrics: list[str], threshold: float = 0.5, *, query_id: str = "query_id") -> DataFrame:
    """(query_id, metric, value) of all values below the threshold, nulls included."""
    long = results.select(query_id, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    return long.select(query_id, "m.*").where(F.col("value").isNull() | (F.col("value") < threshold))
