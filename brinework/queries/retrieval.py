"""Vector, keyword and hybrid search, reranking, packing and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.functions import pooling
from brinework.functions.vectors import cosine, normalised
from brinework.operators import cells, context, inverted, rerank, search
from brinework.plans import sql_functions
from brinework.plans.answers import answer
from brinework.queries import query, table
from brinework.session import working_folder

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_VEC = "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]) AS sim FROM embeddings)"


def _first_vector(emb: DataFrame) -> list[float]:
    return emb.where("vec_id = 0").select("embedding").first()[0]


@query(_VEC + ", t AS (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 20) SELECT t.vec_id AS doc_id, round(sim, 6) AS similarity, lang, source FROM t JOIN documents d ON d.doc_id = t.vec_id")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of one, narrowed before the join with their documents."""
    emb = table(spark, sf_dir, "embeddings")
    top = search.vector_topk(emb, _first_vector(emb), k=20, min_similarity=-1.0)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return docs.join(F.broadcast(top), "vec_id").select(F.col("vec_id").alias("doc_id"), F.round("similarity", 6).alias("similarity"), "lang", "source")


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS sim FROM embeddings, q), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 10"
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, against all vectors."""
    emb = table(spark, sf_dir, "embeddings")
    queries = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.batch_topk(emb, queries, k=10).withColumn("similarity", F.round("similarity", 6))


@query(_VEC + " SELECT vec_id, label, round(sim, 6) AS similarity FROM s WHERE sim >= 0.3")
def vector_threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    sim = cosine("embedding", F.array(*[F.lit(float(x)) for x in _first_vector(emb)]))
    return emb.select("vec_id", "label", sim.alias("similarity")).where("similarity >= 0.3").withColumn("similarity", F.round("similarity", 6))


@query(_VEC + " SELECT s.vec_id AS doc_id, round(sim, 6) AS similarity, d.source FROM s JOIN documents d ON d.doc_id = s.vec_id WHERE d.lang = 'en' ORDER BY sim DESC, s.vec_id LIMIT 10")
def vector_lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on the documents before the top ten."""
    emb = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source")
    sim = cosine("embedding", F.array(*[F.lit(float(x)) for x in _first_vector(emb)]))
    rows = emb.join(docs, "vec_id").select(F.col("vec_id").alias("doc_id"), sim.alias("s"), "source").orderBy(F.desc("s"), "doc_id").limit(10)
    return rows.select("doc_id", F.round("s", 6).alias("similarity"), "source")


@query(
    "WITH e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), l AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY label) "
    "SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM l a JOIN l b ON a.label < b.label"
)
def model_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each pair of label centroids."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cent = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    a, b = cent.select(F.col("label").alias("label_a"), F.col("v").alias("va")), cent.select(F.col("label").alias("label_b"), F.col("v").alias("vb"))
    return a.join(F.broadcast(b), F.col("label_a") < F.col("label_b")).select("label_a", "label_b", F.round(cosine("va", "vb"), 6).alias("similarity"))


@query("WITH e AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM e")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x").cast("double")
    rows = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.min(x), 6).alias("min"), F.round(F.max(x), 6).alias("max"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x), 'sum'), 5) AS norm2 FROM embeddings")
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors: their squared length is one."""
    v = normalised("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2"))


_POOLED = (
    "WITH t AS (SELECT label, vec_id // 16 AS part, vec_id, vec_id % 3 <> 0 AS on_, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), "
    "p AS (SELECT label, part, i, avg(x) FILTER (on_) AS mean, arg_min(x, vec_id) AS first, max(x) FILTER (on_) AS max, arg_max(x, vec_id) FILTER (on_) AS last FROM t GROUP BY ALL) "
    "SELECT label, part, i, round(coalesce(mean, 0), 6) AS mean, round(first, 6) AS first, round(max, 6) AS max, round(last, 6) AS last FROM p"
)


@query(_POOLED)
def token_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label, some at a time, as tokens of a text of which every third is masked: pooled in four ways."""
    emb = table(spark, sf_dir, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 16))
    rows = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    texts = emb.groupBy("label", "part").agg(rows.alias("rows")).select(
        F.struct("label", "part").alias("chunk_id"), F.transform("rows", lambda r: r["embedding"]).alias("tokens"), F.transform("rows", lambda r: (r["vec_id"] % 3 != 0).cast("int")).alias("mask")
    )
    out = None
    for mode in pooling.MODES:
        each = pooling.pooled(texts, mode).select("chunk_id", F.posexplode_outer("embedding").alias("i", mode))
        each = each.where("i is not null").withColumn(mode, F.round(mode, 6))
        out = each if out is None else out.join(each, ["chunk_id", "i"], "left")
    return out.select("chunk_id.label", "chunk_id.part", (F.col("i") + 1).alias("i"), *pooling.MODES)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


_Q = f"q AS (SELECT item_id AS query_id, list_distinct({TOK.format('text')}) AS w, text AS query FROM benchmark)"
_D = f"d AS (SELECT doc_id AS chunk_id, {TOK.format('text')} AS t, text, lang, source FROM documents)"
_KW = (
    f"{_Q}, {_D}, c AS (SELECT chunk_id, len(t) AS n, unnest(t) AS word FROM d), tf AS (SELECT chunk_id, n, word, count(*) AS k FROM c GROUP BY ALL), qw AS (SELECT query_id, len(w) AS need, unnest(w) AS word FROM q), "
    "h AS (SELECT query_id, chunk_id, n, need, count(*) AS got, sum(k) AS k FROM tf JOIN qw USING (word) GROUP BY ALL), "
    "kw AS (SELECT query_id, chunk_id, k / n AS score, row_number() OVER (PARTITION BY query_id ORDER BY k / n DESC, chunk_id) AS rank FROM h)"
)


@query(f"WITH {_KW} SELECT query_id, chunk_id FROM h WHERE got = need")
def keyword_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold every word of an item."""
    return search.keyword_search(_chunks(spark, sf_dir), _queries(spark, sf_dir)).select("query_id", "chunk_id")


@query(f"WITH {_KW} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kw WHERE rank <= 10")
def keyword_density_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with the largest share of words of an item."""
    return _ranked(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return search.keyword_search(_chunks(spark, sf_dir), _queries(spark, sf_dir), k=k, match="any")


def _index(spark: SparkSession, sf_dir: str) -> inverted.Index:
    return inverted.build(_chunks(spark, sf_dir), working_folder(spark, "index"))


@query(f"WITH {_KW} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kw WHERE rank <= 10")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index, of which blocks that can't reach the ten best stay unread."""
    return inverted.topk(_index(spark, sf_dir), _queries(spark, sf_dir), k=10).withColumn("score", F.round("score", 6))


@query()
def keyword_index_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks each query has words in, and how many of them are read for its ten best."""
    blocks = inverted.blocks_to_read(_index(spark, sf_dir), _queries(spark, sf_dir), k=10)
    return blocks.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum(F.col("read").cast("long")).alias("read"))


@query(
    f"WITH {_Q}, {_D}, tok AS (SELECT chunk_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM d), qw AS (SELECT query_id, len(w) AS need, unnest(w) AS word FROM q), "
    "hit AS (SELECT query_id, need, chunk_id, word, pos, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS i FROM tok JOIN qw USING (word)), "
    "full_ AS (SELECT query_id, chunk_id FROM hit GROUP BY query_id, chunk_id, need HAVING count(DISTINCT word) = need), h AS (SELECT hit.* FROM hit JOIN full_ USING (query_id, chunk_id)), "
    "last_ AS (SELECT e.query_id, e.chunk_id, e.pos, e.i, e.need, b.word, max(b.pos) AS p FROM h e JOIN h b ON b.query_id = e.query_id AND b.chunk_id = e.chunk_id AND b.pos <= e.pos GROUP BY ALL), "
    "ends AS (SELECT query_id, chunk_id, pos, i, min(p) AS begins FROM last_ GROUP BY query_id, chunk_id, pos, i, need HAVING count(*) = need), "
    "covers AS (SELECT query_id, chunk_id, begins, min(pos) AS pos, min(i) AS i FROM ends GROUP BY query_id, chunk_id, begins), "
    "scored AS (SELECT c.query_id, c.chunk_id, sum(0.1::DOUBLE / (1 + (c.pos - c.begins) - (c.i - h.i))) AS score FROM covers c JOIN h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id AND h.pos = c.begins GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored) SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"
)
def cover_density_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold every word of an item, those first in which the words stand near each other."""
    return inverted.cover_topk(_index(spark, sf_dir), _queries(spark, sf_dir), k=10).withColumn("score", F.round("score", 6))


@query()
def vector_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, from a stored index of cells: an approximation of vector_topk_batch."""
    emb = table(spark, sf_dir, "embeddings")
    queries = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = cells.build(emb, working_folder(spark, "cells"))
    return cells.topk(index, queries, k=10).withColumn("similarity", F.round("similarity", 6))


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vector and keyword hits of the benchmark items; an item's vector is the one of the same id."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = _queries(spark, sf_dir)
    vectors = queries.join(emb.withColumnRenamed("chunk_id", "query_id"), "query_id").select("query_id", F.col("embedding").alias("query_vector"))
    v = search.batch_topk(emb, vectors, k=20, min_similarity=0.0, id_col="chunk_id").withColumnRenamed("similarity", "score")
    return v.withColumn("score", F.round("score", 6)), _ranked(spark, sf_dir, 20).withColumn("score", F.round("score", 6))


_HITS = (
    f"WITH {_KW}, s AS (SELECT item_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS sim FROM benchmark JOIN embeddings x ON x.vec_id = item_id, embeddings e), "
    "v AS (SELECT query_id, chunk_id, sim AS score, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s WHERE sim >= 0), "
    "b AS (SELECT query_id, chunk_id, round(score, 6) AS score, rank, 0 AS s FROM v WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, round(score, 6), rank, 1 FROM kw WHERE rank <= 20)"
)


def _fused_sql(value: str) -> str:
    return (
        f"{_HITS}, m AS (SELECT query_id, chunk_id, {value} AS fused, min(s * 1000 + rank) AS f FROM b GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, f) AS rank FROM m) SELECT query_id, chunk_id, round(fused, 8) AS fused, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"
    )


def _fused(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return search.fuse(*_hits(spark, sf_dir), method=method, k=10).withColumn("fused", F.round("fused", 8))


@query(_fused_sql("sum(1.0::DOUBLE / (60 + rank))"))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "rrf")


@query(_fused_sql("sum(score * CASE s WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)"))
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "weighted")


@query(_fused_sql("greatest(0, max(score))"))
def hybrid_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "max")


@query(f"{_HITS} SELECT query_id, chunk_id, max(score) FILTER (s = 0) AS vector_score, max(score) FILTER (s = 1) AS keyword_score FROM b GROUP BY ALL")
def fusion_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse_outer(*_hits(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir)
    rows = search.beside_chunks(_ranked(spark, sf_dir, 15), _chunks(spark, sf_dir), 15 * queries.count()).join(queries, "query_id")
    return rows.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("similarity"), "query", F.col("text").alias("content"), (F.col("chunk_id") % 7).cast("int").alias("chunk_index"))


_KEYS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[가-힣a-zA-Z0-9]+')), lambda w: len(w) >= 2)"
_CAND = (
    f"WITH {_KW}, cc AS (SELECT kw.query_id, kw.chunk_id, rank, round(score, 6) AS sim, b.text AS query, d.text AS content, kw.chunk_id % 7 AS chunk_index FROM kw JOIN d USING (chunk_id) JOIN benchmark b ON b.item_id = kw.query_id WHERE rank <= 15), "
    f"k AS (SELECT *, {_KEYS.format('query')} AS a, {_KEYS.format('content')} AS b FROM cc), "
    "p AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / len(a) END AS kws, 1.0::DOUBLE / (1.0::DOUBLE + abs(length(content) - 200) / 200.0::DOUBLE) AS lens, 1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE * chunk_index) AS poss FROM k)"
)


def _rerank_sql(score: str, top: int = 15, base: str = "p", prior: str = "rank") -> str:
    return (
        f"{_CAND}, r AS (SELECT query_id, chunk_id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 12) DESC, {prior}) AS new FROM {base}) "
        f"SELECT query_id, chunk_id, round(score, 8) AS score, CAST(new AS INT) AS rank FROM r WHERE new <= {top}"
    )


def _reranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 8).alias("score"), "rank")


@query(_rerank_sql("(1 - 0.3::DOUBLE) * sim + 0.3::DOUBLE * kws"))
def rerank_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(rerank.rerank(_candidates(spark, sf_dir), rerank.blend(rerank.keyword_score(), 0.3)))


@query(_rerank_sql("(1 - 0.1::DOUBLE) * sim + 0.1::DOUBLE * lens"))
def rerank_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(rerank.rerank(_candidates(spark, sf_dir), rerank.blend(rerank.length_score(), 0.1)))


@query(_rerank_sql("(1 - 0.1::DOUBLE) * sim + 0.1::DOUBLE * poss"))
def rerank_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(rerank.rerank(_candidates(spark, sf_dir), rerank.blend(rerank.position_score(), 0.1)))


@query(
    _rerank_sql("(1 - 0.4::DOUBLE) * sim + 0.4::DOUBLE * sem", base="s").replace(", r AS (", ", s AS (SELECT p.*, coalesce(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), sim) AS sem FROM p LEFT JOIN embeddings x ON x.vec_id = p.query_id LEFT JOIN embeddings y ON y.vec_id = p.chunk_id), r AS (", 1)
)
def rerank_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the vectors of item and document; the keyword score where one has none."""
    emb = table(spark, sf_dir, "embeddings")
    rows = _candidates(spark, sf_dir).join(emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id", "left")
    rows = rows.join(emb.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("cv")), "chunk_id", "left")
    return _reranked(rerank.semantic(rows, query=F.col("qv"), content=F.col("cv")))


_COMBINED = "(0.5::DOUBLE * sim + 0.5::DOUBLE * 0.6::DOUBLE * kws + 0.5::DOUBLE * 0.2::DOUBLE * lens + 0.5::DOUBLE * 0.2::DOUBLE * poss)"


@query(_rerank_sql(_COMBINED))
def rerank_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(rerank.standard(_candidates(spark, sf_dir)))


@query(
    f"{_CAND}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({_COMBINED}, 12) DESC, rank) AS one FROM p), t AS (SELECT * FROM o WHERE one <= 9), "
    "r AS (SELECT query_id, chunk_id, kws AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(kws, 12) DESC, one) AS new FROM t) SELECT query_id, chunk_id, round(score, 8) AS score, CAST(new AS INT) AS rank FROM r WHERE new <= 3"
)
def two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(rerank.two_stage(_candidates(spark, sf_dir), rerank.keyword_score(), k=3))


@query(f"{_CAND} SELECT query_id, chunk_id, round(CASE WHEN max(sim) OVER w = min(sim) OVER w THEN 0.5::DOUBLE ELSE (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) END, 6) AS scaled FROM p WINDOW w AS (PARTITION BY query_id)")
def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("query_id", "chunk_id", F.round(rerank.min_max(F.col("similarity")), 6).alias("scaled"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.pack(_candidates(spark, sf_dir), budget=1500, max_documents=5)


_PACK = (
    f"{_CAND}, f AS (SELECT query_id, chunk_id, rank, sim, content, len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS n FROM p WHERE rank <= 5), "
    "g AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f), "
    "x AS (SELECT query_id, chunk_id, rank, sim, CAST(least(n, 1500 - b) AS INT) AS words, n > 1500 - b AS cut FROM g WHERE b < 1500 AND (n <= 1500 - b OR 1500 - b > 100))"
)


@query(f"{_PACK} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, words, cut FROM x")
def context_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("query_id", "chunk_id", "rank", "words", "cut")


@query(f"{_PACK} SELECT query_id, count(*) AS n_documents, round(avg(sim), 6) AS avg_similarity FROM x GROUP BY query_id")
def context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted context of each query, by its counts."""
    return context.formatted(_packed(spark, sf_dir), style="markdown").select("query_id", "n_documents", F.round("avg_similarity", 6).alias("avg_similarity"))


_SUMMARY, _QA = context.PURPOSES["summarization"], context.PURPOSES["qa"]


@query(
    f"{_CAND} SELECT query_id, md5('{_SUMMARY[0]}' || chr(10) || chr(10) || '{_SUMMARY[1]}: ' || any_value(query) || chr(10) || chr(10) || '{_SUMMARY[2]}:' || chr(10) || string_agg('[문서 ' || rank || ']' || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) || '{_SUMMARY[3]}') AS summarization, "
    f"md5('{_QA[0]}' || chr(10) || chr(10) || '{_QA[1]}: ' || any_value(query) || chr(10) || chr(10) || '{_QA[2]}:' || chr(10) || string_agg(rank || '. (유사도: ' || format('{{:.3f}}', round(sim, 3)) || ') ' || content || chr(10) || chr(10), '' ORDER BY rank) FILTER (rank <= 3) || '{_QA[3]}') AS qa FROM p GROUP BY query_id"
)
def context_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts for summarising and for answering, as digests."""
    rows = _candidates(spark, sf_dir).withColumn("similarity", F.round("similarity", 3))
    whole = context.purpose_context(rows, "summarization").select("query_id", F.md5("context").alias("summarization"))
    return whole.join(context.purpose_context(rows, "qa").select("query_id", F.md5("context").alias("qa")), "query_id")


def _level_sql(texts: dict[str, str], otherwise: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items())
    return f"CASE level {cases} ELSE '{texts[otherwise]}' END"


@query(
    "WITH t AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced' ELSE 'expert' END AS level FROM conversations) "
    f"SELECT conv_id, turn, md5('{context.RULES}' || chr(10) || {_level_sql(context.MANNERS, 'beginner')}) AS system, md5('질문: ' || text || chr(10) || chr(10) || '[컨텍스트]' || chr(10) || level || chr(10) || chr(10) || '요구 형식: ' || {_level_sql(context.STRUCTURES, 'intermediate')}) AS user FROM t"
)
def level_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System and user prompts of every message for its level, as digests."""
    n = F.col("turn") % 4
    rows = table(spark, sf_dir, "conversations").withColumn("level", F.when(n == 0, "beginner").when(n == 1, "intermediate").when(n == 2, "advanced").otherwise("expert"))
    return rows.select("conv_id", "turn", F.md5(context.system_prompt("level")).alias("system"), F.md5(context.user_prompt("text", "level", "level")).alias("user"))


def _sql_functions(spark: SparkSession, sf_dir: str) -> None:
    emb = table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model"), F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sql_functions.register(spark, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), emb)


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sql_cosine_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql_functions(spark, sf_dir)
    return spark.sql("SELECT a.chunk_id AS vec_id, round(cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM chunk_vectors a JOIN chunk_vectors b ON b.chunk_id = a.chunk_id + 1")


@query("WITH s AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) x), r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= 0) SELECT CAST(vec_id AS VARCHAR) AS chunk_id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 10")
def sql_search_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql_functions(spark, sf_dir)
    return spark.sql("SELECT chunk_id, round(similarity, 6) AS similarity, rank FROM search_similar_chunks((SELECT embedding FROM chunk_vectors WHERE chunk_id = 0), 'm', 10)")


@query(f"{_PACK} SELECT query_id, string_agg(rank::INT || '. ' || chunk_id, chr(10) ORDER BY rank) AS citation_list FROM x GROUP BY query_id")
def citations_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return context.citation_list(context.citations(rows.unionByName(rows)))


@query(
    f"SELECT conv_id, turn, contains(text, '[ref:') AS grounded, length(text) + CASE WHEN contains(text, '{context.DISCLAIMED}') OR contains(text, '{context.DISCLAIMER}') THEN 0 ELSE {len(context.DISCLAIMER)} END AS answer_chars FROM conversations WHERE role = 'assistant'"
)
def grounding_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", context.grounded("text").alias("grounded"), F.length(context.guarded("text")).cast("long").alias("answer_chars"))


@query()
def question_answering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search, rerank, pack, format, extractive answer, guardrail for all benchmark items."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return answer(_queries(spark, sf_dir), _chunks(spark, sf_dir), emb, method="keyword", match="any").select("query_id", "answer", "grounded", "citation_list", "n_documents")
