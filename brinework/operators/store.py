"""Chunks and their vectors as one store over two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.operators import dedupe, search


@dataclass(frozen=True)
class VectorTable:
    """``chunks`` (chunk_id, ...) and ``embeddings`` (model, chunk_id, embedding); changes give a new store."""

    chunks: DataFrame
    embeddings: DataFrame

    def insert(self, chunks: DataFrame) -> VectorTable:
        """With the chunks whose id is new; of repeated ids one stays, the first by its columns."""
        order = [c for c in self.chunks.columns if c != "chunk_id"]
        return replace(self, chunks=dedupe.insert_new(self.chunks, chunks, ["chunk_id"], order or ["chunk_id"]))

    def embed(self, vectors: DataFrame) -> VectorTable:
        """With the vectors, in place of those of the same model and chunk; of repeated ones the greatest stays."""
        fresh = vectors.groupBy("model", "chunk_id").agg(F.max("embedding").alias("embedding"))
        kept = dedupe.delete_keys(self.embeddings, fresh, ["model", "chunk_id"]).select("model", "chunk_id", "embedding")
        return replace(self, embeddings=kept.unionByName(fresh))

    def delete(self, gone: DataFrame) -> VectorTable:
        """Without the chunks listed in ``gone`` (chunk_id) and their vectors."""
        chunks, embeddings = dedupe.delete_cascade(self.chunks, gone, ["chunk_id"], self.embeddings)
        return VectorTable(chunks, embeddings)

    def truncate(self) -> VectorTable:
        return VectorTable(self.chunks.limit(0), self.embeddings.limit(0))

    def get(self, wanted: DataFrame) -> DataFrame:
        return dedupe.only_listed(self.chunks, wanted, "chunk_id")

    def pending(self, model: str) -> DataFrame:
        """Chunks without a vector of the model."""
        return dedupe.pending(self.chunks, self.embeddings.where(F.col("model") == model), "chunk_id", "chunk_id")

    def statistics(self) -> DataFrame:
        """(model, vectors, chunks): vectors of each model, and how many of them belong to a chunk."""
        known = self.chunks.select("chunk_id").distinct().withColumn("_known", F.lit(True))
        return self.embeddings.join(known, "chunk_id", "left").groupBy("model").agg(F.count("*").alias("vectors"), F.count("_known").alias("chunks"))

    def search(self, queries: DataFrame, model: str, *, k: int = 5, min_similarity: float = 0.0) -> DataFrame:
        """The k chunks of the model most similar to each (query_id, query_vector), with their columns."""
        vectors = self.embeddings.where(F.col("model") == model).select("chunk_id", "embedding")
        return search.batch_topk(vectors, queries, k=k, min_similarity=min_similarity, id_col="chunk_id").join(self.chunks, "chunk_id")
