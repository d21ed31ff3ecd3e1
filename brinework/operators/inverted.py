"""A stored inverted index: posting blocks with their largest impact, and searches that leave blocks unread.

Documents are put into blocks of like length, so that the impact of a word
(occurrences per word of the text) differs between blocks.  A search knows from
the blocks' heads how much a document of a block can score at most, and reads
only blocks that can still reach the k best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.operators.search import BLOCK_CELLS, tokens

#: Documents of one block (about) and words of them at most (about), and steps of length within which a block's documents lie, per doubling.
BLOCK_DOCUMENTS, BLOCK_WORDS, LENGTH_STEPS = 512, 1 << 20, 4
#: Blocks that are read first for each query, to learn what the k-th best score is at least.
FIRST_BLOCKS = 4
#: Weight of a word in a cover (the value that full-text search gives words without a class).
COVER_WEIGHT = 0.1


@dataclass
class Index:
    """postings: (word, block, n, impact, docs, counts, gaps, ids, lengths).

    A word's row in a block lists the documents that hold it (their numbers in
    the block, in order of id), how often each does, and its places in them, each
    as the distance from the one before.  The row of the empty word has the
    block's documents themselves: their ids and lengths.
    """

    postings: DataFrame

    @property
    def heads(self) -> DataFrame:
        """Word, block, number of entries and largest impact: the columns that a search reads of all blocks of its words."""
        return self.postings.where("word <> ''").select("word", "block", "n", "impact")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(path))


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))


def _block_postings(rows: pa.Table) -> pa.Table:
    """The postings of one block, from its documents (block, id, words), the words parted by blanks."""
    rows = rows.filter(pc.not_equal(rows["words"], ""))
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start")).combine_chunks()
    ids, lists = rows["id"].combine_chunks(), pc.split_pattern(rows["words"].combine_chunks(), " ")
    lengths = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    code, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # short numbers are sorted faster
    order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) < 1 << 16 else code, kind="stable")
    code, doc, place = code[order], doc[order], place[order]
    starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    gaps = np.diff(place, prepend=0)
    gaps[starts] = place[starts]
    counts, doc, code = np.diff(np.append(starts, len(place))), doc[starts], code[starts]
    firsts = np.flatnonzero(np.diff(code, prepend=-1))
    offsets, words = np.append(firsts, len(code)), len(firsts)
    one = pa.table(
        {
            "word": coded.dictionary.take(pa.array(code[firsts])),
            "block": rows["block"].combine_chunks().take(pa.array(np.zeros(words, np.int64))),
            "n": pa.array(np.diff(offsets).astype(np.int32)),
            "impact": pa.array(np.maximum.reduceat(counts / lengths[doc], firsts)),
            "docs": _lists(offsets, doc),
            "counts": _lists(offsets, counts),
            "gaps": _lists(np.append(starts, len(place))[offsets], gaps),
            "ids": pa.nulls(words, pa.list_(ids.type)),
            "lengths": pa.nulls(words, pa.list_(pa.int32())),
        }
    )
    if not words:
        return one
    whole = np.array([0, len(ids)])
    own = {"word": pa.array([""]), "block": rows["block"].slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "ids": _lists(whole, ids), "lengths": _lists(whole, lengths)}
    return pa.concat_tables([one, pa.table([own[f.name] if f.name in own else pa.nulls(1, f.type) for f in one.schema], schema=one.schema)])


def build(chunks: DataFrame, path: str, *, id_col: str = "chunk_id", text: str = "text", files: int | None = None) -> Index:
    """Writes the index of ``chunks`` to ``path`` and opens it.

    Words are lower-cased runs of letters and digits.  Null texts and texts
    without words have no postings.  Ids are distinct.  A word that all documents hold is spread over the
    blocks; entries of a block are some ``BLOCK_DOCUMENTS``.  The words of a text
    are shuffled once, to the task that makes the postings of its block.  Each file is
    sorted by word, so that Parquet's statistics lead to the words of a search.
    """
    kind = dict(chunks.dtypes)[id_col]
    rows = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("words")).select("id", F.array_join("words", " ").alias("words"), F.size("words").alias("length"))
    # texts without words drop out in their block: a filter here, or a step that may be null, would cut every text into words twice
    rows = rows.withColumn("step", F.coalesce(F.floor(F.log2(F.greatest("length", F.lit(1))) * LENGTH_STEPS).cast("int"), F.lit(0)))
    parts = F.ceil(F.greatest(F.sum((F.col("length") > 0).cast("int")) / BLOCK_DOCUMENTS, F.sum("length") / BLOCK_WORDS))
    classes = rows.groupBy("step").agg(F.greatest(parts, F.lit(1)).cast("int").alias("parts"))
    # one row for each step of length, some hundred at most
    held = rows.join(F.broadcast(classes), "step").select((F.col("step").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id", "words")
    dealt = held.repartition(files, "block") if files else held
    kinds = f"word string, block long, n int, impact double, docs array<int>, counts array<int>, gaps array<int>, ids array<{kind}>, lengths array<int>"
    dealt.groupBy("block").applyInArrow(_block_postings, kinds).sortWithinPartitions("word", "block").write.mode("overwrite").parquet(path)
    return Index.open(chunks.sparkSession, path)


def asked_words(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(query_id, words): the distinct words of each query that has any."""
    return queries.select(query_id, F.array_distinct(tokens(F.col(query))).alias("words")).where("size(words) > 0")


def bounds(index: Index, asked: DataFrame, *, match: str, query_id: str) -> DataFrame:
    """(query_id, block, most): what a document of the block can score at most; with ``all``, blocks that lack a word are left out."""
    words = asked.select(query_id, F.size("words").alias("need"), F.explode("words").alias("word"))
    heads = index.heads.join(words, "word").groupBy(query_id, "block", "need").agg(F.sum("impact").alias("most"), F.count("*").alias("got"))
    return (heads.where("got = need") if match == "all" else heads).select(query_id, "block", "most")


def _block_hits(names: list[str], every: bool, cover: bool):
    """(query, id, score) of one block's documents that match, from its postings and the queries that read it."""

    def hits(held: pa.Table, wanted: pa.Table) -> pa.Table:
        held, wanted = held.combine_chunks(), wanted.combine_chunks()
        own = pc.equal(held["word"], "")
        about, held = held.filter(own), held.filter(pc.invert(own)).combine_chunks()
        made = [[], [], []]
        if held.num_rows and wanted.num_rows:
            ids, lengths = about["ids"].combine_chunks().flatten(), about["lengths"].combine_chunks().flatten().to_numpy()
            for query, doc, score in cells(held, wanted, lengths):
                for column, values in zip(made, (wanted[names[0]].combine_chunks().take(pa.array(query)), ids.take(pa.array(doc)), pa.array(score)), strict=True):
                    column.append(values)
        kinds = (wanted.schema.field(names[0]).type, held.schema.field("ids").type.value_type, pa.float64())
        return pa.table([pa.chunked_array(c, t) for c, t in zip(made, kinds, strict=True)], names=names)

    def cells(held: pa.Table, wanted: pa.Table, lengths: np.ndarray):
        """Query, document and score of the hits of some queries at a time: ``BLOCK_CELLS`` entries of postings, about."""
        lists = held["docs"].combine_chunks()
        doc, counts = lists.flatten().to_numpy(), held["counts"].combine_chunks().flatten().to_numpy()
        first, sizes = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), np.diff(lists.offsets.to_numpy())
        gaps, ends = (held["gaps"].combine_chunks().flatten().to_numpy(), np.cumsum(counts)) if cover else (None, None)
        asked = wanted["words"].combine_chunks()
        need = np.diff(asked.offsets.to_numpy())
        code = pc.fill_null(pc.index_in(asked.flatten(), value_set=held["word"].combine_chunks()), -1).to_numpy()
        of = np.repeat(np.arange(len(need)), need)
        of, code = of[code >= 0], code[code >= 0]
        step = max(1, BLOCK_CELLS * len(need) // max(1, len(of) * len(lengths)))
        for low in range(0, len(need), step):
            n = min(step, len(need) - low)
            a, b = np.searchsorted(of, [low, low + n])
            times = sizes[code[a:b]]
            at = np.repeat(first[code[a:b]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cell = np.repeat(of[a:b] - low, times) * len(lengths) + doc[at]
            got = np.bincount(cell, minlength=n * len(lengths))
            hit = np.flatnonzero(got == np.repeat(need[low : low + n], len(lengths)) if every else got)
            if cover:
                order = np.argsort(cell, kind="stable")
                begins, cell = np.searchsorted(cell[order], hit), at[order]
                score = np.array([cover_density([np.cumsum(gaps[ends[p] - counts[p] : ends[p]]) for p in cell[i : i + got[h]]]) for i, h in zip(begins, hit, strict=True)], np.float64)
            else:
                score = np.bincount(cell, counts[at], n * len(lengths))[hit] / lengths[hit % len(lengths)]
                least = wanted["least"].to_numpy()[low + hit // len(lengths)]
                hit, score = hit[score >= least], score[score >= least]
            yield low + hit // len(lengths), hit % len(lengths), score

    return hits


def matches(index: Index, asked: DataFrame, blocks: DataFrame, *, match: str, query_id: str, id_col: str, cover: bool = False) -> DataFrame:
    """(query_id, id, score) of the documents of given (query_id, block, least) that match and score ``least``, or by cover density.

    The postings of the queries' words go to the task of their block once, however many
    queries share them; of a query and a document only the score comes out.
    """
    words = asked.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).distinct()
    held = index.postings.select("block", "word", "docs", "counts", "ids", "lengths", *(["gaps"] if cover else []))
    held = held.join(words, "word", "left_semi").join(blocks.select("block").distinct(), "block", "left_semi")
    wanted = blocks.join(asked, query_id).withColumnRenamed("block", "in_block")
    kinds = {query_id: wanted.schema[query_id].dataType, id_col: index.postings.schema["ids"].dataType.elementType}
    result = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items()) + ", score double"
    return held.groupBy("block").cogroup(wanted.groupBy("in_block")).applyInArrow(_block_hits([*kinds, "score"], match == "all", cover), result)


def blocks_to_read(index: Index, queries: DataFrame, *, k: int, match: str = "any", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, block, most, least, read): each block of a query's words, and whether it can hold one of its k best.

    ``least`` is the k-th best score of the blocks that promise most, 0 where they hold fewer documents.
    """
    asked = asked_words(queries, query_id, query)
    limits = bounds(index, asked, match=match, query_id=query_id)
    first = limits.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("most"), "block"))).where(F.col("place") <= FIRST_BLOCKS)
    scores = matches(index, asked, first.select(query_id, "block", F.lit(0.0).alias("least")), match=match, query_id=query_id, id_col="id")
    best = scores.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score")))).where(F.col("place") == k)
    marked = limits.join(best.select(query_id, F.col("score").alias("least")), query_id, "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    # the bound is a sum of rounded shares: a little is given in
    return marked.withColumn("read", F.col("most") * (1 + 1e-9) >= F.col("least"))


def topk(index: Index, queries: DataFrame, *, k: int = 10, match: str = "any", id_col: str = "chunk_id", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, id, score, rank) of the k best documents of each query, as ``search.keyword_search`` ranks them.

    Exact: a block is left unread only if none of its documents can reach the
    k-th best score.  Texts are not read.
    """
    if match not in ("all", "any"):
        raise ValueError(f"unknown match {match!r}")
    asked = asked_words(queries, query_id, query)
    blocks = blocks_to_read(index, queries, k=k, match=match, query_id=query_id, query=query).where("read")
    scored = matches(index, asked, blocks.select(query_id, "block", "least"), match=match, query_id=query_id, id_col=id_col)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)))
    return ranked.where(F.col("rank") <= k)


def cover_density(lists: list[np.ndarray]) -> float:
    """Sum over all minimal stretches of a text that hold every word: the weight of a word by one more than the other words inside.

    lists: sorted positions of each word.
    """
    if not lists or any(len(x) == 0 for x in lists):
        return 0.0
    places = np.unique(np.concatenate(lists))
    # for each place, the nearest place of every word up to there; the earliest of them begins the stretch
    last = np.stack([np.concatenate([[-1], x])[np.searchsorted(x, places, "right")] for x in lists]).min(0)
    ends = np.flatnonzero((last >= 0) & (np.diff(last, prepend=-1) > 0))
    begins = np.searchsorted(places, last[ends])
    others = (places[ends] - places[begins]) - (ends - begins)
    return float((COVER_WEIGHT / (1 + others)).sum())


def cover_topk(index: Index, queries: DataFrame, *, k: int = 10, id_col: str = "chunk_id", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, id, score, rank) of documents that hold all words of a query, by cover density: near words count more.

    Each stretch of the text that holds all words, and none shorter inside it
    does, adds 0.1 / (1 + words in it that are none of the query's).
    """
    asked = asked_words(queries, query_id, query)
    blocks = bounds(index, asked, match="all", query_id=query_id).select(query_id, "block")
    scored = matches(index, asked, blocks, match="all", query_id=query_id, id_col=id_col, cover=True)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id_col)))
    return ranked.where(F.col("rank") <= k)
