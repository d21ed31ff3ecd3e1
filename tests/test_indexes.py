import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinework.catalog import QUERIES
from brinework.operators import cells, inverted, search

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    return inverted.build(chunks, str(tmp_path_factory.mktemp("index")), files=4)


@pytest.fixture(scope="module")
def queries(spark):
    """Words of documents that no benchmark item asks for: two of each fiftieth document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 50 = 7")
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 3, 2), " ").alias("query"))


@pytest.mark.parametrize(("match", "k"), [("any", 3), ("all", 5)])
def test_index_ranks_as_reading_every_text_does(chunks, index, queries, match, k):
    want = search.keyword_search(chunks, queries, k=k, match=match).select("query_id", "chunk_id", "rank", F.round("score", 12).alias("score"))
    got = inverted.topk(index, queries, k=k, match=match).select("query_id", "chunk_id", "rank", F.round("score", 12).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_that_can_not_reach_the_best_stay_unread(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (1 + i % 3) + ["x"] * (i % 200))) for i in range(2000)]
    old = inverted.BLOCK_DOCUMENTS
    inverted.BLOCK_DOCUMENTS = 64
    try:
        index = inverted.build(spark.createDataFrame(rows, "chunk_id int, text string"), str(tmp_path / "i"))
    finally:
        inverted.BLOCK_DOCUMENTS = old
    marked = inverted.blocks_to_read(index, spark.createDataFrame([(1, "w")], "query_id int, query string"), k=5)
    read, all_blocks = marked.where("read").count(), marked.count()
    assert all_blocks > 20 and read < all_blocks / 4


def test_index_of_odd_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "a A b"), (5, "b"), (None, "a")], "chunk_id int, text string")
    index = inverted.build(rows, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a"), (2, "b a"), (3, ""), (4, None), (5, "zzz")], "query_id int, query string")
    got = sorted((r.query_id, r.rank, r.chunk_id) for r in inverted.topk(index, asked, match="all").collect())
    assert got == [(1, 1, None), (1, 2, 4), (2, 1, 4)]
    empty = inverted.build(rows.limit(0), str(tmp_path / "e"))
    assert inverted.topk(empty, asked).count() == 0 and inverted.cover_topk(empty, asked).count() == 0


@pytest.mark.parametrize("name", ["keyword_index_topk", "cover_density_topk", "keyword_index_blocks"])
def test_index_and_search_shuffle_no_more_than_a_few_times_the_texts(spark, name):
    """A row for each word of each text, or of each query and text, would be some twenty times the input."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    assert QUERIES[name](spark, SF).count() > 0
    assert shuffled() - before < 4 * os.path.getsize(f"{SF}/documents.parquet")


def test_blocks_of_long_texts_hold_fewer_of_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_WORDS", 500)
    rows = [(i, " ".join(f"w{j}" for j in range(100))) for i in range(60)] + [(-1, ""), (-2, None)]
    index = inverted.build(spark.createDataFrame(rows, "chunk_id int, text string"), str(tmp_path / "i"))
    blocks = index.postings.where("word = ''").collect()
    assert len(blocks) > 6
    assert sorted(i for b in blocks for i in b.ids) == list(range(60))


@pytest.mark.parametrize("cells", [1, 2_000_000])
def test_search_of_some_queries_at_a_time(spark, tmp_path, monkeypatch, cells):
    """Results don't depend on how many queries of a block are scored at a time; string ids."""
    draw = random.Random(5)
    rows = [(f"d{i}", " ".join(draw.choice("abcdefg") for _ in range(draw.randint(0, 12)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "chunk_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(draw.sample("abcdefgz", draw.randint(0, 3)))) for i in range(12)], "query_id int, query string")
    index = inverted.build(docs, str(tmp_path / "i"))
    monkeypatch.setattr(inverted, "BLOCK_CELLS", cells)
    for match in ("all", "any"):
        want = search.keyword_search(docs, asked, k=4, match=match).select("query_id", "chunk_id", "rank", "score")
        got = inverted.topk(index, asked, k=4, match=match).select("query_id", "chunk_id", "rank", "score")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    words = dict(rows)
    for r in inverted.cover_topk(index, asked, k=200).join(asked, "query_id").collect():
        text = words[r.chunk_id].split()
        lists = [np.array([i for i, w in enumerate(text) if w == q]) for q in dict.fromkeys(r.query.split())]
        assert r.score == inverted.cover_density(lists) > 0


def test_cover_density_equals_trying_every_stretch():
    draw = random.Random(3)
    for _ in range(300):
        words, n = draw.randint(1, 4), draw.randint(1, 14)
        text = [draw.randint(0, words + 1) for _ in range(n)]
        lists = [np.array([i for i, w in enumerate(text) if w == q]) for q in range(words)]

        def holds(a, b, text=text, words=words):
            return set(range(words)) <= set(text[a : b + 1])

        stretches = [(a, b) for a in range(n) for b in range(a, n) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
        want = sum(0.1 / (1 + sum(w >= words for w in text[a : b + 1])) for a, b in stretches)
        assert inverted.cover_density(lists) == pytest.approx(want)


def test_cells_find_nearly_all_neighbours(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    want = {(r.query_id, r.vec_id) for r in QUERIES["vector_topk_batch"](spark, sf).collect()}
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    built = cells.build(emb, str(tmp_path / "c"))
    index = cells.Cells.open(spark, str(tmp_path / "c"))
    asked = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = [(r.query_id, r.vec_id) for r in cells.topk(index, asked, k=10).collect()]
    assert len(got) == len(set(got)) == len(want)
    assert len(want & set(got)) / len(want) >= 0.9
    assert built.probes == index.probes <= index.centres.count()


def test_cells_with_every_cell_probed_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 30)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    odd = [(900, None), (901, [0.0] * 8), (902, [None] * 8)]
    emb = spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in rows[:7]] + [("none", None), ("zero", [0.0] * 8)], "query_id string, query_vector array<double>")
    index = cells.build(emb, str(tmp_path / "c"), cells=5, k=3)
    assert index.rows.select("cell", "part").distinct().count() > 5
    got = cells.topk(index, asked, k=3, probes=5, wider=8).select("query_id", "rank", "vec_id")
    want = search.batch_topk(emb.where("vec_id < 900"), asked.where("query_id like 'q%'"), k=3).select("query_id", "rank", "vec_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="centres"):
        cells.build(emb, str(tmp_path / "d"), cells=10_000_000)
