"""Questions to answers, all questions of a table at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.operators import context as C
from brinework.operators.rerank import standard
from brinework.operators.rewrite import rewrite
from brinework.operators.search import search


def answer(questions: DataFrame, chunks: DataFrame, embeddings: DataFrame, *, method: str = "keyword", match: str = "all", k: int = 5, budget: int = 4000, style: str = "prompt", filings: DataFrame | None = None, as_of: dt.date | None = None, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, query, context, answer, grounded, citation_list, n_documents, avg_similarity).

    Search, rerank, pack, format, answer, check, guard.  ``generate`` adds an
    ``answer`` column from (query, context); by default the first sentences of
    the context are the answer.  Questions without results get the note alone.
    """
    if filings is not None and as_of is not None:
        questions = rewrite(questions.withColumn("question", F.col("query")), filings, as_of).withColumn("query", F.col("rewritten")).drop("question", "rewritten", "temporal")
    found = search(chunks, embeddings, questions, method=method, k=k, match=match)
    base = questions.select("query_id", "query")
    cand = found.join(base, "query_id").withColumn("similarity", F.col("score")).withColumn("content", F.col("text"))
    if "chunk_index" not in cand.columns:
        cand = cand.withColumn("chunk_index", F.lit(0))
    top = standard(cand, top=k)
    packed = C.pack(top, budget=budget, max_documents=k)
    texts = C.formatted(packed, style=style)
    cited = C.citation_list(C.citations(packed))
    out = base.join(texts, "query_id", "left").join(cited, "query_id", "left")
    out = generate(out) if generate else out.withColumn("answer", C.fallback_answer("context"))
    return out.withColumn("grounded", C.grounded("answer")).withColumn("answer", C.guarded("answer"))
