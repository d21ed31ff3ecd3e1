"""Rerankers of (query_id, id, similarity, ...) candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.text import keywords
from brinework.functions.vectors import cosine, hashed_embedding

#: A reranker adds or replaces ``score``; anything callable like this plugs in.
Reranker = Callable[[DataFrame], DataFrame]


def keyword_score(query: str = "query", content: str = "content") -> Column:
    """Share of the query's distinct keywords in the content; 0 without keywords."""
    want = F.array_distinct(keywords(query))
    return F.when(F.size(want) == 0, 0.0).otherwise(F.size(F.array_intersect(want, keywords(content))) / F.size(want))


def length_score(content: str = "content", best: int = 200) -> Column:
    return 1.0 / (1.0 + F.abs(F.length(content) - best) / F.lit(float(best)))


def position_score(index: str = "chunk_index") -> Column:
    return 1.0 / (1.0 + 0.1 * F.coalesce(F.col(index), F.lit(0)))


def semantic_score(query: Column | None = None, content: Column | None = None, *, similarity: str = "similarity") -> Column:
    """Cosine of the two vectors, by default of hashed keywords; the prior similarity where one is null."""
    query = hashed_embedding(keywords("query"), 512) if query is None else query
    content = hashed_embedding(keywords("content"), 512) if content is None else content
    return F.coalesce(cosine(query, content), F.col(similarity))


def blend(score: Column, weight: float, similarity: str = "similarity") -> Column:
    return (1.0 - weight) * F.col(similarity) + weight * score


def combined_score(parts: dict[str, Column], weights: dict[str, float], similarity: str = "similarity") -> Column:
    """Half the similarity and half the weighted parts, over the weights in use."""
    total = sum(weights[k] for k in parts)
    value = 0.5 * F.col(similarity)
    for k, c in parts.items():
        value = value + 0.5 * weights[k] * c
    return value / (0.5 + 0.5 * total)


def rerank(candidates: DataFrame, score: Column, *, top: int | None = None, query_id: str = "query_id", prior: str = "rank") -> DataFrame:
    """Candidates with ``score`` and their new ``rank``; equal scores keep their prior order."""
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), "_prior")
    out = candidates.withColumn("_prior", F.col(prior)).withColumn("score", score).withColumn("rank", F.row_number().over(order)).drop("_prior")
    return out if top is None else out.where(F.col("rank") <= top)


def standard(candidates: DataFrame, *, top: int | None = None, weights: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Keyword, length and position scores combined with the similarity."""
    parts = {"keyword": keyword_score(), "length": length_score(), "position": position_score()}
    return rerank(candidates, combined_score(parts, dict(zip(parts, weights, strict=True))), top=top)


def two_stage(candidates: DataFrame, scorer: Column, *, k: int = 5, multiplier: float = 3.0) -> DataFrame:
    """The standard reranker keeps k * multiplier, ``scorer`` orders those and keeps k."""
    return rerank(standard(candidates, top=int(k * multiplier)), scorer, top=k)


def semantic(candidates: DataFrame, *, query: Column | None = None, content: Column | None = None, weight: float = 0.4, top: int | None = None) -> DataFrame:
    """Reranked by similarity and the cosine of newly encoded texts, which is kept as ``semantic_score``."""
    rows = candidates.withColumn("semantic_score", semantic_score(query, content))
    return rerank(rows, blend(F.col("semantic_score"), weight), top=top)


def unchanged(candidates: DataFrame, *, top: int = 5, query_id: str = "query_id", prior: str = "rank") -> DataFrame:
    """The first ``top`` candidates of each query as they are."""
    w = Window.partitionBy(query_id).orderBy(prior)
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def min_max(score: Column, query_id: str = "query_id") -> Column:
    """Scores of a query from 0 to 1; 0.5 where all are equal."""
    w = Window.partitionBy(query_id)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 0.5).otherwise((score - low) / (high - low))
