"""Vector, keyword and hybrid top-k search over many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.vectors import cosine

#: Queries of one block, and bytes of the vectors of one part: a task holds both, and their product.
QUERY_BLOCK, PART_BYTES = 1024, 16_000_000
#: Chunks times words of all queries of one block of a keyword search.
BLOCK_CELLS = 2_000_000
#: Hits (ids and scores) that are broadcast to be joined with their chunks.
BROADCAST_HITS = 1_000_000


def vector_topk(embeddings: DataFrame, query: list[float], *, k: int = 5, min_similarity: float = 0.0, condition: Column | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors of one query vector: id, similarity.  Ties go to the smaller id."""
    rows = embeddings if condition is None else embeddings.where(condition)
    scored = rows.select(id_col, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    return scored.where(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), id_col).limit(k)


def best_rows(names: list, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple]:
    """(name, id, similarity) of the k nearest vectors of each query; ties go to the smaller id, a zero vector has similarity 0."""
    lengths, own = (np.linalg.norm(x, axis=1, keepdims=True) for x in (vectors, queries))
    similarity = (vectors / np.where(lengths > 0, lengths, np.inf)) @ (queries / np.maximum(own, 1e-300)).T
    for j, name in enumerate(names):
        score = similarity[:, j]
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
        for i in sorted(near, key=lambda i: (-score[i], ids[i]))[:k]:
            yield name, ids[i], float(score[i])


def batch_topk(embeddings: DataFrame, queries: DataFrame, *, k: int = 5, min_similarity: float = -1.0, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, rank, id, similarity) of the k nearest vectors of each query.

    The queries are a stated set: they go in blocks (``QUERY_BLOCK`` each, of
    one vector length) against all vectors of that length, themselves in parts
    of some ``PART_BYTES``.  Each pair of a block and a part is one task's group,
    a matrix product, from which k rows per query are shuffled.  Exact.  Rows
    whose vector or one of its components is null are left out, on either side, empty vectors too;
    zero vectors have similarity 0; a query without vectors of its length has
    no rows.
    """
    kind, name_kind = embeddings.schema[id_col].dataType, queries.schema[query_id].dataType

    def usable(c: str) -> Column:
        return (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull())

    asked = queries.where(usable(query_vector)).select(F.col(query_id).cast("string").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).withColumn("dim", F.size("v"))
    rows = embeddings.where(usable(vector)).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("dim", F.size("v"))
    # how many blocks and parts each length gets: a few numbers, joined to the rows
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    parts = rows.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") * 8 / PART_BYTES).cast("int").alias("parts"))
    shape = F.broadcast(blocks.join(parts.withColumn("parts", F.greatest("parts", F.lit(1))), "dim"))
    asked = asked.join(shape, "dim").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.join(shape, "dim").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def pair(found: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, names = found["id"].to_pylist(), wanted["q"].to_pylist()
        matrices = [t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (found, wanted)]
        best = list(best_rows(names, matrices[1], ids, matrices[0], k)) if ids and names else []
        columns = zip(*best, strict=True) if best else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), found.schema.field("id").type, pa.float64()), strict=True)], names=["q", id_col, "similarity"])

    keys = ("dim", "block", "part")
    best = rows.select(*keys, "id", "v").groupBy(*keys).cogroup(asked.select(*keys, "q", "v").groupBy(*keys)).applyInArrow(pair, f"q string, `{id_col}` {kind.simpleString()}, similarity double")
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), id_col)
    ranked = best.where(F.col("similarity") >= min_similarity).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").cast(name_kind).alias(query_id), "rank", id_col, "similarity")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _word_hits(asked: pa.Table, ids: str, out: list[str], k: int | None, every: bool):
    """Arrow batches of (id, words) to (query, id, score): all hits, or the k best of each query in the task.

    asked: (query, need, word, n).  Words of a text are counted where it is
    read, some texts at a time (``BLOCK_CELLS``); of k best no more are held.
    """
    names, wanted = asked.column_names, asked.group_by(asked.column_names[:2], use_threads=False).aggregate([])
    place = {q: i for i, q in enumerate(zip(*(wanted[c].to_pylist() for c in names[:2]), strict=True))}
    of = np.array([place[q] for q in zip(*(asked[c].to_pylist() for c in names[:2]), strict=True)], np.int64)
    words = asked[names[2]].combine_chunks().dictionary_encode()
    codes, vocabulary, weight = words.indices.to_numpy(), words.dictionary, asked[names[3]].to_numpy()
    order = np.argsort(codes, kind="stable")
    of, weight, degree = of[order], weight[order], np.bincount(codes, minlength=len(vocabulary))
    first, need, queries = np.cumsum(degree) - degree, wanted[names[1]].to_numpy(), len(place)
    step = max(1, BLOCK_CELLS // max(1, len(of)))

    def block(tokens: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, query and score of the hits of some texts."""
        pairs, n = np.unique(rows * len(vocabulary) + tokens, return_counts=True)
        row, code = np.divmod(pairs, len(vocabulary))
        times = degree[code]
        at = np.repeat(first[code] - np.cumsum(times) + times, times) + np.arange(times.sum())
        cell, shape = np.repeat(row, times) * queries + of[at], (len(sizes), queries)
        got = np.bincount(cell, weight[at], len(sizes) * queries).reshape(shape)
        row, query = np.nonzero(got == need if every else got)
        tf = np.bincount(cell, weight[at] * np.repeat(n, times), len(sizes) * queries).reshape(shape)
        return row, query, tf[row, query] / sizes[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(t: pa.Table) -> list[pa.RecordBatch]:
            made = [wanted[names[0]].combine_chunks().take(t["q"].combine_chunks()), t["id"].combine_chunks(), t["score"].combine_chunks()]
            return pa.Table.from_arrays(made, names=out).to_batches()

        best, least = None, np.zeros(queries)
        for batch in batches:
            lists, of_id = batch.column("_words"), batch.column(ids)
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            found = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            for low in range(0, len(sizes), step):
                some = sizes[low : low + step]
                tokens, rows = found[ends[low] : ends[low + len(some)]], np.repeat(np.arange(len(some)), some)
                row, query, score = block(tokens[tokens >= 0], rows[tokens >= 0], some)
                if k is not None:
                    near = score >= least[query]
                    row, query, score = row[near], query[near], score[near]
                if not len(row):
                    continue
                more = pa.table({"q": query, "id": of_id.take(pa.array(low + row)), "score": score})
                if k is None:
                    yield from result(more)
                    continue
                more = more if best is None else pa.concat_tables([best, more])
                more = more.take(pc.sort_indices(more, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
                q = more["q"].to_numpy()
                begins = np.searchsorted(q, np.arange(queries))
                best = more.take(pa.array(np.flatnonzero(np.arange(len(q)) - begins[q] < k)))
                q = best["q"].to_numpy()
                last = np.searchsorted(q, np.arange(queries), "right") - 1
                full = np.flatnonzero(np.bincount(q, minlength=queries) == k)
                least[full] = best["score"].to_numpy()[last[full]]
        if best is not None:
            yield from result(best)

    return run


def _joined_hits(split: DataFrame, wanted: DataFrame, id_col: str, query_id: str, every: bool) -> DataFrame:
    """The same by joins, for more words than can be sent out, and for rows that share an id: those of one length count together."""
    asked = split.select(id_col, F.size("_words").alias("_len"), F.explode("_words").alias("_word")).join(wanted.select("_word").distinct(), "_word", "left_semi")
    counts = asked.groupBy(id_col, "_len", "_word").agg(F.count("*").alias("_tf"))
    hits = counts.join(wanted, "_word").groupBy(query_id, id_col, "_len", "_need").agg(F.sum("_n").alias("_got"), F.sum(F.col("_tf") * F.col("_n")).alias("_tf"))
    return (hits.where("_got = _need") if every else hits).select(query_id, id_col, (F.col("_tf") / F.col("_len")).alias("score"))


def keyword_search(chunks: DataFrame, queries: DataFrame, *, k: int | None = None, match: str = "all", broadcast_words: int = 500_000, id_col: str = "chunk_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, id, score, rank) of the chunks that hold every word of a query, or with ``match="any"`` one of them.

    The score is the number of occurrences of the query's words per word of the
    chunk.  At most ``broadcast_words`` words of queries go to all tasks, which
    count them in each chunk where it is read and, with ``k``, pass on the k
    best of each query, so no word is shuffled.  With more words, and for
    chunks that share an id, chunk words join query words by equality.
    """
    if match not in ("all", "any"):
        raise ValueError(f"unknown match {match!r}")
    every = match == "all"
    wanted = queries.select(query_id, F.array_distinct(tokens(F.col(query))).alias("_w")).where("size(_w) > 0")
    wanted = wanted.select(query_id, F.size("_w").alias("_need"), F.explode("_w").alias("_word")).groupBy(query_id, "_need", "_word").agg(F.count("*").alias("_n"))
    split = chunks.select(id_col, tokens(F.col(text)).alias("_words"))
    if wanted.count() > broadcast_words:
        scored = _joined_hits(split, wanted, id_col, query_id, every)
    else:
        twice = chunks.groupBy(F.col(id_col).alias("_twice")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_twice")
        again = None
        if not twice.isEmpty():
            shared = F.col(id_col).eqNullSafe(F.col("_twice"))
            again = _joined_hits(split.join(twice, shared, "left_semi"), wanted, id_col, query_id, every)
            split = split.join(twice, shared, "left_anti")
        scored = split.where("size(_words) > 0").mapInArrow(_word_hits(wanted.toArrow(), id_col, [query_id, id_col, "score"], k, every), f"`{query_id}` {wanted.schema[query_id].dataType.simpleString()}, `{id_col}` {chunks.schema[id_col].dataType.simpleString()}, score double")
        scored = scored if again is None else scored.unionByName(again)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def beside_chunks(found: DataFrame, chunks: DataFrame, rows: int, *, id_col: str = "chunk_id") -> DataFrame:
    """Hits with the columns of their chunks; up to ``BROADCAST_HITS`` hits go to the wide chunks, which stay where they are."""
    return (F.broadcast(found) if rows <= BROADCAST_HITS else found).join(chunks, id_col)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, *, method: str = "rrf", k: int = 10, rrf_k: int = 60, weights: tuple[float, float] = (0.7, 0.3), query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """One ranking from two of (query_id, id, score, rank): rrf, weighted or max.

    Ties go to the hit that stands first in the vector list, then in the keyword list.
    """
    both = vector_hits.select(query_id, id_col, "score", "rank", F.lit(0).alias("_s")).unionByName(keyword_hits.select(query_id, id_col, "score", "rank", F.lit(1).alias("_s")))
    if method == "rrf":
        value = F.sum(1.0 / (F.lit(rrf_k) + F.col("rank")))
    elif method == "weighted":
        value = F.sum(F.col("score") * F.when(F.col("_s") == 0, weights[0]).otherwise(weights[1]))
    elif method == "max":
        value = F.greatest(F.lit(0.0), F.max("score"))
    else:
        raise ValueError(f"unknown fusion {method!r}")
    merged = both.groupBy(query_id, id_col).agg(value.alias("fused"), F.min(F.struct("_s", "rank")).alias("_first"))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("fused", 12)), "_first._s", "_first.rank")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, id_col, "fused", "rank")


def fuse_outer(vector_hits: DataFrame, keyword_hits: DataFrame, *, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Both lists side by side: vector_score and keyword_score, null where a list lacks the hit."""
    v = vector_hits.select(query_id, id_col, F.col("score").alias("vector_score"))
    return v.join(keyword_hits.select(query_id, id_col, F.col("score").alias("keyword_score")), [query_id, id_col], "full_outer")


def with_context(hits: DataFrame, content: str = "content", before: str = "prev_context", after: str = "next_context") -> DataFrame:
    """``enriched``: the text between its neighbours, each under its heading; what is missing is left out."""
    def part(title: str, c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(title + "\n"), F.col(c)))

    return hits.withColumn("enriched", F.concat_ws("\n", part("[이전 문맥]", before), part("[검색된 내용]", content), part("[다음 문맥]", after)))


def search(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, *, method: str = "vector", k: int = 5, min_similarity: float = 0.0, fusion: str = "rrf", match: str = "all") -> DataFrame:
    """(query_id, rank, chunk_id, score) by ``vector``, ``keyword`` or ``hybrid``, with the chunk's columns.

    queries: query_id, query and, but for keyword search, query_vector.  Scores
    and ids are narrowed to the top k before the wide chunks are joined.
    """
    if method not in ("vector", "keyword", "hybrid"):
        raise ValueError(f"unknown method {method!r}")
    wide = 2 * k if method == "hybrid" else k
    found = None
    if method != "keyword":
        found = batch_topk(embeddings, queries, k=wide, min_similarity=min_similarity, id_col="chunk_id").withColumnRenamed("similarity", "score")
    if method != "vector":
        words = keyword_search(chunks, queries, k=wide, match=match)
        found = words if found is None else fuse(found, words, method=fusion, k=k).withColumnRenamed("fused", "score")
    return beside_chunks(found, chunks, queries.count() * k)
