"""Vector functions for SQL, as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"


def register(spark: SparkSession, chunks: DataFrame | None = None, embeddings: DataFrame | None = None) -> None:
    """``cosine_similarity(a, b)``, and with both tables ``search_similar_chunks(q, wanted, k, least)``.

    cosine_similarity: null for a null vector, 0 for different lengths or a zero vector.
    search_similar_chunks: the k (5) chunks of the model ``wanted`` most similar to
    the vector q, at least ``least`` (0), equal ones by id; an unknown model is an
    error.  ``chunks`` has chunk_id and text, ``embeddings`` model, chunk_id and embedding.
    """
    size = f"{_NORM.format('a')} * {_NORM.format('b')}"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) OR {size} = 0 THEN 0D ELSE {_DOT} / ({size}) END"
    )
    if chunks is None or embeddings is None:
        return
    chunks.createOrReplaceTempView("chunk_texts")
    embeddings.createOrReplaceTempView("chunk_vectors")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION search_similar_chunks(q ARRAY<DOUBLE>, wanted STRING, k INT DEFAULT 5, least DOUBLE DEFAULT 0D) "
        "RETURNS TABLE(chunk_id STRING, text STRING, similarity DOUBLE, rank INT) RETURN "
        "WITH models AS (SELECT collect_set(model) AS names FROM chunk_vectors), "
        "known AS (SELECT CASE WHEN array_contains(names, wanted) THEN wanted ELSE raise_error('unknown model ' || coalesce(wanted, 'null')) END AS name FROM models), "
        "scored AS (SELECT v.chunk_id, cosine_similarity(q, v.embedding) AS similarity FROM chunk_vectors v JOIN known ON v.model = known.name), "
        "parts AS (SELECT *, row_number() OVER (PARTITION BY pmod(hash(chunk_id), 1000) ORDER BY similarity DESC, chunk_id) AS place FROM scored WHERE similarity >= least), "
        "ranked AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank FROM parts WHERE place <= k) "
        "SELECT CAST(r.chunk_id AS STRING), c.text, r.similarity, r.rank FROM ranked r JOIN chunk_texts c ON c.chunk_id = r.chunk_id WHERE r.rank <= k"
    )
