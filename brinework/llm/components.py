"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm._shared import materialize


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (src, dst); the component is its smallest node.

    Alternates large-star and small-star steps: each node's neighbours are
    linked to its smallest neighbour, first the larger ones, then the smaller
    ones, until nothing changes.  The number of rounds grows with the logarithm
    of the longest path.  Self loops keep a node; null ends are left out.
    """
    both = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).where("u is not null and v is not null")
    nodes = both.select(F.col("u").alias("node")).unionAll(both.select("v")).distinct()
    links = materialize(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        up = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = links.unionAll(up)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
