"""Chat sessions and messages as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.operators.dedupe import keep_latest


def add_messages(sessions: DataFrame, messages: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the incoming messages; blank ones are skipped, sessions get the time of their last message."""
    fresh = incoming.where(F.trim(F.coalesce(F.col("content"), F.lit(""))) != "")
    last = fresh.groupBy("session_id").agg(F.max("timestamp").alias("_t"))
    touched = sessions.join(last, sessions.id == last.session_id, "left").withColumn("updated_at", F.greatest("updated_at", "_t")).select(sessions.columns)
    return touched, messages.unionByName(fresh.select(messages.columns))


def latest_sessions(log: DataFrame) -> DataFrame:
    """The last state of each session in an append-only log (id, title, created_at, updated_at)."""
    return keep_latest(log, ["id"], ["updated_at", "title"]).orderBy(F.desc("updated_at"), "id")


def session_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Each session with its messages in order of time, in one join."""
    line = F.struct(F.col("timestamp"), F.col("msg_id"), F.col("role"), F.col("content"))
    folded = messages.withColumnRenamed("id", "msg_id").groupBy("session_id").agg(F.sort_array(F.collect_list(line)).alias("messages"))
    return sessions.join(folded, sessions.id == folded.session_id, "left").drop("session_id")


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions whose id is listed, and their messages."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    return sessions.join(ids, sessions.id == F.col("_gone"), "left_anti"), messages.join(ids, messages.session_id == F.col("_gone"), "left_anti")


def import_sessions(sessions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New sessions and their messages from JSON rows (id, title, created_at, messages array); known ids are skipped."""
    fresh = files.join(sessions.select("id"), "id", "left_anti")
    rows = fresh.select(F.col("id").alias("session_id"), F.posexplode("messages").alias("n", "m")).select("session_id", "n", "m.*").where(F.trim(F.coalesce(F.col("content"), F.lit(""))) != "")
    return fresh.drop("messages"), rows


def turns(messages: DataFrame, *, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Question-answer pairs: each user message with the assistant message right after it."""
    w = Window.partitionBy(session).orderBy(order)
    out = messages.withColumns({"answer": F.lead("text").over(w), "_next": F.lead("role").over(w)})
    return out.where("role = 'user' and _next = 'assistant'").drop("_next")
