"""Queries over a keyword search count words where a text is read: no row a word is made of the documents."""

import pytest

from brinework.catalog import QUERIES

NAMES = [
    "context_purposes",
    "fusion_full_outer",
    "hybrid_weighted",
    "metric_recall_precision_mrr_ndcg",
    "overall_score",
    "rerank_keyword",
    "rerank_position",
    "hybrid_rrf",
    "min_max_scores",
    "model_comparison",
    "rerank_combined",
    "rerank_semantic",
    "metric_summary",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_words_of_documents_are_exploded(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "mapInArrow" in plan or "MapInArrow" in plan
    assert "explode(_words" not in plan
