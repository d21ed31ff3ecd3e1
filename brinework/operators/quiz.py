"""An adaptive quiz: five steps over a table of transitions, then a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 5


def walk(answers: DataFrame, transitions: DataFrame, questions: DataFrame, first: str, *, steps: int = STEPS) -> DataFrame:
    """(user_id, step, question, correct, difficulty) of the questions that each user gets.

    answers: (user_id, question, choice); transitions: (step, current, correct,
    next), the fixed tree; questions: (question, answer, difficulty).  Both of
    the latter are small dimensions and broadcast.  A question without an
    answer counts as wrong; a user without answers isn't in the result.

    Answers are merged with the users at each step, never broadcast: rows made
    by an explode look smaller to the planner than they are.
    """
    users = answers.select("user_id").distinct().withColumn("question", F.lit(first))
    given, out = answers.hint("merge"), None
    for step in range(1, steps + 1):
        asked = users.join(given, ["user_id", "question"], "left").join(F.broadcast(questions), "question")
        graded = asked.select("user_id", F.lit(step).alias("step"), "question", F.coalesce(F.col("choice") == F.col("answer"), F.lit(False)).alias("correct"), "difficulty")
        out = graded if out is None else out.unionByName(graded)
        edges = F.broadcast(transitions.where(F.col("step") == step).drop("step").withColumnRenamed("current", "question"))
        users = graded.join(edges, ["question", "correct"]).select("user_id", F.col("next").alias("question"))
    return out


def levels(walked: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Per user: number of right answers, the highest difficulty answered right (ranks from 1), and the level."""
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    top = F.max(F.when(F.col("correct"), rank[F.col("difficulty")]))
    scored = walked.groupBy("user_id").agg(F.sum(F.col("correct").cast("int")).alias("n_correct"), F.coalesce(top, F.lit(0)).alias("top_rank"))
    level = F.when((F.col("top_rank") >= 3) & (F.col("n_correct") >= 3), "advanced").when((F.col("top_rank") >= 2) & (F.col("n_correct") >= 2), "intermediate").otherwise("beginner")
    return scored.withColumn("level", level)
