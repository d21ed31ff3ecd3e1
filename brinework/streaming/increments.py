"""Incremental jobs: embedding what is new, counting events in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.functions.text import keywords
from brinework.functions.vectors import hashed_embedding
from brinework.operators.dedupe import keep_first, pending


def hashing_encoder(df: DataFrame, text: str = "natural_text", dimension: int = 64) -> DataFrame:
    """The default encoder: a unit vector of word hashes; texts without words drop out."""
    words = keywords(text)
    return df.where(F.size(words) > 0).withColumn("embedding", hashed_embedding(words, dimension))


def embed_pending(chunks: DataFrame, embeddings: DataFrame, *, model: str = "hashing", encoder: Callable[[DataFrame], DataFrame] = hashing_encoder) -> DataFrame:
    """(model, chunk_id, embedding) of the chunks that have no embedding of the model yet."""
    todo = pending(chunks, embeddings.where(F.col("model") == model), "chunk_id", "chunk_id")
    return encoder(keep_first(todo, ["chunk_id"], ["natural_text"])).select(F.lit(model).alias("model"), "chunk_id", "embedding")


def embed_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *, model: str = "hashing", encoder: Callable[[DataFrame], DataFrame] = hashing_encoder):
    """Embed new files of ``source`` into the Parquet table ``target`` and stop; run again for later files.

    A batch that is replayed after a failure adds nothing twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        session = df.sparkSession
        empty = session.createDataFrame([], "model string, chunk_id string, embedding array<double>")
        path = session._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path)
        done = session.read.schema(empty.schema).parquet(target) if there else empty
        embed_pending(df, done, model=model, encoder=encoder).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tallied(rows: DataFrame, valid: Column, by: list[str], *, least: float = 0.5) -> DataFrame:
    """Rows, good and bad ones of each batch, and whether the share of good ones exceeds ``least``; a null verdict is bad."""
    good = F.coalesce(valid, F.lit(False))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))
    return out.withColumn("accepted", F.col("succeeded") > least * F.col("n"))


def insert_stream(spark: SparkSession, source: str, schema: str, target: str, tallies: str, checkpoint: str, *, valid: Column, files: int = 100, least: float = 0.5):
    """Insert the good rows of new files into ``target`` and the tallies of each batch into ``tallies``, then stop.

    Both tables are Parquet with a folder per batch, so a batch that is replayed
    after a failure replaces itself.  ``files`` is the most files of a batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = df.withColumn("batch_id", F.lit(number).cast("long")).persist()
        for out, path in ((rows.where(F.coalesce(valid, F.lit(False))), target), (tallied(rows, valid, ["batch_id"], least=least), tallies)):
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, *, ts: str = "ts", by: str = "event_type", window: str = "1 day", late: str | None = None) -> DataFrame:
    """Events and value sums per tumbling window and kind; ``late`` sets the watermark of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, *, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user: events closer than ``gap``."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
