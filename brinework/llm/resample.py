"""Importance resampling towards a target: hashed word n-grams taken from a position table.

Only DataFrame functions are used.  Texts are dealt to tasks by row before
their words are exploded, so the window that puts following words beside each
word sorts within a task and moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm._shared import PREFIX, integer_id, materialize, numbered

#: What parts words: ASCII characters other than letters and digits.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW, ID = PREFIX + "row", PREFIX + "id"


def text_words(text: str) -> Column:
    """Words of a text with A-Z lower-cased; null and empty texts have none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NO_WORD), "")


def hashed_positions(rows: DataFrame, *, text: str, orders: int, buckets: int) -> DataFrame:
    """One row per word position of ``rows`` (ROW, ID, text): the buckets b1, b2, ... of the runs that begin there.

    A run that goes beyond the last word has a null bucket; a row without
    words keeps one position of nulls.
    """
    dealt = rows.select(ROW, ID, text).repartition(ROW)
    table = dealt.select(ROW, ID, F.posexplode_outer(text_words(text)).alias("pos", "word"))
    order = Window.partitionBy(ROW).orderBy("pos")
    table = table.select(ROW, ID, F.col("word").alias("w0"), *[F.lead("word", k).over(order).alias(f"w{k}") for k in range(1, orders)])

    def bucket(k: int) -> Column:
        run = F.col("w0") if k == 1 else F.concat_ws(" ", *[f"w{j}" for j in range(k)])
        return F.when(F.col(f"w{k - 1}").isNotNull(), (F.crc32(run.cast("binary")) % buckets).cast("int")).alias(f"b{k}")

    return table.select(ROW, ID, *[bucket(k) for k in range(1, orders + 1)])


def bucket_counts(table: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, ``name``): features in each bucket; counted by order, so that only one column is read at a time."""
    parts = [table.where(F.col(f"b{k}").isNotNull()).groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count("*").alias(name)) for k in range(1, orders + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy("bucket").agg(F.sum(name).alias(name))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), in doubles."""
    all_s, all_t = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((corpus, "s"), (target, "t")))
    spark = corpus.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(corpus, "bucket", "left").join(target, "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A draw from 1000 times the Gumbel distribution, fixed by seed and id; a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, orders: int = 3, buckets: int = 10_000, seed: int = 42, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with n_words, n_features, weight, score and, where it is drawn, its rank.

    Features are runs of 1 to ``orders`` consecutive words, hashed into
    ``buckets``.  The weight of a row is the sum of its features' gains, the
    score adds Gumbel noise, and of the N rows with ``min_words`` words or more
    floor(percent * N / 100) are drawn by falling score, then rising id: a draw
    without replacement in proportion to exp(weight / 1000).

    Null and empty texts have no features, weight 0 and no rank.  Equal rows
    are scored alike and drawn one by one, in any order among them; a null id
    comes after all others.  An empty table gives an empty result; an empty
    target has T = 0.  Other columns are ignored.  Ids are integers.

    Texts are shuffled once; a text must fit a task.  Of the corpus the buckets
    alone are kept (4 bytes a feature before compression).  The ``buckets``
    gains are broadcast: their number is a parameter and doesn't grow.  Rows are
    told apart by a number given while they are read, so ``docs`` should come
    from files or a checkpoint.
    """
    names = [f"b{k}" for k in range(1, orders + 1)]
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), integer_id(docs, doc_id).alias(ID), F.col(text).alias("text"))
    table = materialize(hashed_positions(rows, text="text", orders=orders, buckets=buckets), "positions", codec="zstd")
    other = target.select(F.monotonically_increasing_id().alias(ROW), F.lit(None).cast("long").alias(ID), F.col(text).alias("text"))
    wanted = bucket_counts(hashed_positions(other, text="text", orders=orders, buckets=buckets), orders, "t")
    gains = materialize(bucket_gains(materialize(bucket_counts(table, orders, "s"), "corpus"), materialize(wanted, "target"), buckets), "gains")
    for b in names:
        table = table.join(F.broadcast(gains.select(F.col("bucket").alias(b), F.col("gain").alias(f"g_{b}"))), b, "left")
    weight = sum((F.coalesce(F.col(f"g_{b}"), F.lit(0)) for b in names), F.lit(0).cast("long"))
    count = sum((F.col(b).isNotNull().cast("long") for b in names), F.lit(0).cast("long"))
    sums = table.groupBy(ROW, ID).agg(F.sum(weight).alias("weight"), F.sum(count).alias("n_features"), F.count("b1").alias("n_words"))
    scored = materialize(sums.withColumn("score", F.col("weight") + gumbel(F.col(ID), seed)), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    ranked = numbered(fit.select(ROW, "score", ID), F.desc("score"), F.asc_nulls_last(ID), name="rank").where(F.col("rank") <= drawn)
    out = scored.join(ranked.select(ROW, "rank"), ROW, "left")
    return out.select(F.col(ID).alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")
