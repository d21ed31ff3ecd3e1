import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinework.functions import pooling
from brinework.operators import dedupe
from brinework.operators.bucketed import BucketedTable
from brinework.sources import observed, paged, variants
from brinework.streaming import fetching

SF = "/root/testdata/sf0.01"


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "ts", "event_id", "value")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path, events):
    keys, order = ("user_id", "event_type"), ("ts", "event_id")
    table = BucketedTable(str(tmp_path / "t"), keys, order, buckets=32)
    old, new = events.where("event_id < 9000"), events.where("event_id >= 9000 and user_id in (3, 4)")
    table.create(old)
    before = files(table.path)
    table.upsert(new)
    after = files(table.path)
    want = dedupe.upsert(dedupe.keep_latest(old, list(keys), list(order)), new, list(keys), list(order))
    assert same(table.read(spark), want)
    assert len(before & after) >= 32 - 2 * 5 and before != after
    table.upsert(new)
    assert same(table.read(spark), want)
    table.upsert(new.limit(0))
    assert same(table.read(spark), want)


def test_upsert_that_was_stopped_is_put_in_place_by_the_next(spark, tmp_path, events):
    keys, order = ("event_id",), ("ts",)
    table = BucketedTable(str(tmp_path / "t"), keys, order, buckets=4)
    first, second = events.where("event_id < 50"), events.where("event_id between 40 and 80").withColumn("value", F.lit(-1.0))
    table.create(first)
    table.stage(second)
    os.makedirs(f"{table.path}.staged/broken.part")
    assert same(table.read(spark), first)
    table.recover(spark)
    assert same(table.read(spark), dedupe.upsert(first, second, list(keys), list(order)))
    table.recover(spark)
    assert not os.path.exists(f"{table.path}.staged")


def test_statistics_are_counted_while_rows_are_written(spark, tmp_path, events):
    rows, told = str(tmp_path / "rows"), str(tmp_path / "told")
    got = observed.write_observed(events, rows, told, run="a", valid=F.col("value") > 1)
    good = events.where("value > 1").count()
    assert (got["rows"], got["succeeded"], got["failed"]) == (events.count(), good, events.count() - good)
    assert spark.read.parquet(rows).count() == good
    observed.write_observed(events.withColumn("value", F.lit(None).cast("double")), rows, told, run="b", valid=F.col("value") > 1)
    observed.write_observed(events.limit(10), rows, told, run="a", valid=F.lit(True))
    assert {r.run: (r.rows, r.succeeded, r.failed) for r in observed.statistics_of(spark, told).collect()} == {"a": (10, 10, 0), "b": (events.count(), 0, events.count())}
    assert spark.read.parquet(rows).count() == 10


def test_statistics_of_a_stream(spark, tmp_path):
    source, told = str(tmp_path / "in"), str(tmp_path / "told")

    def batch(df, n):
        observed.write_observed(df, str(tmp_path / "out"), told, run=str(n), valid=F.col("x") > 1)

    for part in ([(0,), (1,), (2,)], [(5,), (None,)]):
        spark.createDataFrame(part, "x int").coalesce(1).write.mode("append").parquet(source)
        q = spark.readStream.schema("x int").parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.run: (r.rows, r.succeeded, r.failed) for r in observed.statistics_of(spark, told).collect()} == {"0": (3, 1, 2), "1": (2, 1, 1)}


def test_variant_columns_prune_the_scan(spark, tmp_path):
    rows = [(i, json.dumps({"k": i % 50, "who": {"name": f"n{i}"}, "tags": [i, "x"]})) for i in range(500)] + [(900, "no json"), (901, None), (902, '{"k": "text"}')]
    path = str(tmp_path / "v")
    variants.write(spark.createDataFrame(rows, "id int, meta_json string"), path, json="meta_json", columns={"k": ("$.k", "int"), "name": ("$.who.name", "string")}, by="k")
    table = spark.read.parquet(path)
    found = table.where("k = 7").select("id", "name", variants.at("$.tags[0]", "int").alias("tag"))
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,7)]" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(i, f"n{i}", i) for i in range(7, 500, 50)]
    assert table.where("id >= 900 and k is null").count() == 3
    got = {(r.path, r.kind): r.rows for r in variants.paths(table, key="id").collect()}
    assert got[("$.k", "BIGINT")] == 500 and got[("$.k", "STRING")] == 1 and ("$.who", "OBJECT<name: STRING>") in got


@pytest.mark.parametrize("mode", pooling.MODES)
def test_pooling_of_ragged_tokens(spark, mode):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal((n, 3)).round(3).tolist(), rng.integers(0, 2, n).tolist()) for i, n in enumerate([1, 4, 2, 7, 3, 5])]
    rows += [(10, [[1.0, 2.0, 3.0]], [0]), (11, [], []), (12, None, None), (13, [[1.0, 2.0, 3.0], [3.0, 0.0, 1.0]], None)]
    got = {r.chunk_id: r.embedding for r in pooling.pooled(spark.createDataFrame(rows, "chunk_id int, tokens array<array<double>>, mask array<int>"), mode).collect()}
    assert len(got) == len(rows)
    for i, tokens, mask in rows:
        if not tokens:
            assert got[i] is None
            continue
        on = [t for t, m in zip(tokens, mask or [1] * len(tokens), strict=True) if m]
        want = {"first": tokens[0], "mean": np.mean(on, 0) if on else [0.0] * 3, "max": np.max(on, 0) if on else None, "last": on[-1] if on else None}[mode]
        assert got[i] is None if want is None else got[i] == pytest.approx(list(want))


def test_pooled_vectors_at_length_one(spark):
    df = spark.createDataFrame([(1, [[3.0, 4.0]])], "chunk_id int, tokens array<array<double>>")
    assert pooling.pooled(df, normalise=True).first().embedding == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError, match="pooling"):
        pooling.pooled(df, "median")


def put_pages(root, kind, window, pages, total=None):
    os.makedirs(f"{root}/{kind}/{window}", exist_ok=True)
    for number, rows in pages.items():
        answer = rows if isinstance(rows, dict) else {"status": "000", "total_count": total or 0, "list": [{"rcept_no": r, "corp_name": f"c{r}"} for r in rows]}
        with open(f"{root}/{kind}/{window}/{number}.json", "w") as f:
            json.dump(answer, f)


@pytest.fixture
def pages(spark, tmp_path):
    root = str(tmp_path / "pages")
    put_pages(root, "A001", "20240101-20240331", {1: ["1", "2"], 2: ["3"], 3: ["beyond the total"]}, total=3)
    put_pages(root, "A001", "20240401-20240630", {1: ["4"], 3: ["behind a gap"]})
    put_pages(root, "A002", "20240101-20240331", {1: {"status": "013", "message": "none"}})
    spark.dataSource.register(paged.PagedFilings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return root


def test_pages_are_read_window_by_window(spark, pages):
    rows = spark.read.format("paged_filings").load(pages)
    got = sorted((r.kind, r.start, r.page, r.place, r.rcept_no) for r in rows.collect())
    assert got == [("A001", "20240101", 1, 0, "1"), ("A001", "20240101", 1, 1, "2"), ("A001", "20240101", 2, 0, "3"), ("A001", "20240401", 1, 0, "4")]
    assert rows.rdd.getNumPartitions() == 3
    some = rows.where("kind = 'A001' and start = '20240401' and rcept_no > '1'")
    assert some.rdd.getNumPartitions() == 1 and [r.rcept_no for r in some.collect()] == ["4"]
    assert rows.where("kind = 'none'").count() == 0


def test_an_answer_with_an_error_fails_or_is_skipped(spark, pages):
    put_pages(pages, "A003", "20240101-20240331", {1: {"status": "020", "message": "too many calls"}})
    with pytest.raises(Exception, match="too many calls"):
        spark.read.format("paged_filings").load(pages).collect()
    assert spark.read.format("paged_filings").option("onError", "skip").load(pages).count() == 4


def test_stream_reads_each_page_once(spark, pages, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = spark.readStream.format("paged_filings").load(pages).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.rcept_no for r in spark.read.parquet(out).collect())

    assert run() == ["1", "2", "3", "4", "beyond the total"]
    put_pages(pages, "A001", "20240401-20240630", {2: ["5"]})
    put_pages(pages, "A004", "20240101-20240331", {1: ["6"]})
    assert run() == ["1", "2", "3", "4", "5", "6", "behind a gap", "beyond the total"]
    assert run() == ["1", "2", "3", "4", "5", "6", "behind a gap", "beyond the total"]


def test_failed_ids_come_again_and_replays_change_nothing(spark, tmp_path):
    source, out, check, tries = (str(tmp_path / x) for x in ("in", "out", "check", "tries"))
    os.makedirs(tries)

    def fetch(key):
        with open(f"{tries}/{key}", "a") as f:
            f.write("x")
        if key.startswith("never") or (key.startswith("later") and os.path.getsize(f"{tries}/{key}") < 3):
            raise OSError(key)
        return f"text of {key}"

    for name, value in fetching.SETTINGS.items():
        spark.conf.set(name, value)

    def add(ids):
        spark.createDataFrame([(i,) for i in ids], "rcept_no string").coalesce(1).write.mode("append").parquet(source)

    def run(until):
        stream = fetching.fetched(spark.readStream.schema("rcept_no string").parquet(source), fetch, wait=0.5, most=4)
        q = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(processingTime="1 second").start(out)
        try:
            limit = time.time() + 120
            while time.time() < limit and not until():
                assert q.exception() is None
                time.sleep(0.5)
        finally:
            q.stop()
        return sorted((r.id, r.attempt, r.status, r.content) for r in spark.read.schema(fetching.OUTPUT).parquet(out).collect())

    def rows():
        return {(r.id, r.status) for r in spark.read.schema(fetching.OUTPUT).parquet(out).collect()} if os.path.exists(f"{out}/_spark_metadata") else set()

    add(["good", "later", "never", None, "good"])
    got = run(lambda: ("later", "failed") in rows())
    assert ("good", 1, "success", "text of good") in got and ("never", 1, "failed", None) in got
    # stopped while ids wait for their timers; the same ids are listed again, and one more
    add(["good", "never", "new"])
    got = run(lambda: {("later", "success"), ("never", "given up"), ("new", "success")} <= rows())
    assert [r for r in got if r[0] == "good"] == [("good", 1, "success", "text of good")]
    assert [r[1:3] for r in got if r[0] == "later"] == [(1, "failed"), (2, "failed"), (3, "success")]
    assert [r[1:3] for r in got if r[0] == "never"] == [(1, "failed"), (2, "failed"), (3, "failed"), (4, "given up")]
    assert [r[1:] for r in got if r[0] == "new"] == [(1, "success", "text of new")]
