"""Operators on rows in order: neighbours, ordinals, islands, heading paths and greedy merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, *, partition: list[str], order: list[str | Column], text: str = "text", limit: int = 100) -> DataFrame:
    """``prev_context`` and ``next_context``: the first ``limit`` words of the rows beside, '...' where cut."""
    w = Window.partitionBy(*partition).orderBy(*order)

    def short(c: Column) -> Column:
        words = F.split(c, " ")
        return F.when(F.size(words) > limit, F.concat(F.concat_ws(" ", F.slice(words, 1, limit)), F.lit("..."))).otherwise(c)

    return df.withColumns({"prev_context": short(F.lag(text).over(w)), "next_context": short(F.lead(text).over(w))})


def ordinal_ids(df: DataFrame, *, document: str, kind: str, section: str, order: list[str | Column], name: str = "chunk_id") -> DataFrame:
    """Ids ``document_kind_section_NNN``: the section's last element in word characters, at most ten; NNN counts each kind of a document."""
    n = F.row_number().over(Window.partitionBy(document, kind).orderBy(*order)) - 1
    last = F.substring(F.regexp_replace(F.element_at(F.split(F.col(section), " > "), -1), r"[^\p{L}\p{N}_]", ""), 1, 10)
    return df.withColumn(name, F.concat_ws("_", F.col(document), F.col(kind), last, F.format_string("%03d", n)))


def islands(df: DataFrame, breaks: Column, *, partition: list[str], order: list[str | Column], name: str = "island") -> DataFrame:
    """Numbers runs of rows; a row where ``breaks`` holds starts the next run."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(breaks.cast("int")).over(w))


def change_islands(df: DataFrame, keys: list[str], *, partition: list[str], order: list[str | Column], name: str = "island") -> DataFrame:
    """Numbers runs of neighbouring rows that agree in ``keys``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    key = F.struct(*keys)
    marked = df.withColumn("_new", ~F.coalesce(key.eqNullSafe(F.lag(key).over(w)), F.lit(False)))
    return islands(marked, F.col("_new"), partition=partition, order=order, name=name).drop("_new")


def heading_paths(lines: DataFrame, *, document: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """Heading lines (# to ######) with ``level``, ``title`` and ``path``, and all others with the path they stand under.

    A heading of level n is put under at most n - 1 of the headings above it,
    so skipped levels nest siblings.  One fold per document over its headings
    only; body lines take the last path above them.
    """
    level = F.length(F.regexp_extract(F.col(text), r"^(#{1,6})\s", 1))
    marked = lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.when(level > 0, F.trim(F.regexp_replace(text, r"^#{1,6}\s+", ""))))
    heads = marked.where("level is not null").groupBy(document).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("n"), "level", "title"))).alias("h"))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(f"array<struct<n:{dict(lines.dtypes)[order]},path:string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        stack = F.concat(F.slice(acc["stack"], F.lit(1), F.least(F.size(acc["stack"]), h["level"] - 1)), F.array(h["title"]))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["n"].alias("n"), F.concat_ws(" > ", stack).alias("path")))).alias("out"))

    paths = heads.select(document, F.explode(F.aggregate("h", start, step, lambda acc: acc["out"])).alias("p")).select(document, F.col("p.n").alias(order), F.col("p.path").alias("_path"))
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(paths, [document, order], "left").withColumn("path", F.coalesce(F.last("_path", ignorenulls=True).over(w), F.lit(""))).drop("_path")


def greedy_groups(df: DataFrame, *, partition: list[str], order: str, size: str, budget: int, name: str = "group") -> DataFrame:
    """Numbers groups of neighbouring rows whose sizes add up to at most ``budget``; a larger row is alone.

    The running sum starts anew with each group, so it is a fold over the
    ordered sizes of each partition, which must fit a task's memory; (partition,
    order) is unique.
    """
    items = df.groupBy(*partition).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["out"]) > 0) & (acc["sum"] + x["s"] > budget)
        g = F.when(full, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(full, x["s"]).otherwise(acc["sum"] + x["s"]).alias("sum"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    groups = F.aggregate("a", start, step, lambda acc: acc["out"])
    out = items.select(*partition, F.explode(F.arrays_zip(F.col("a"), groups.alias("g"))).alias("z")).select(*partition, F.col("z.a.o").alias(order), F.col("z.g").alias(name))
    return df.join(out, [*partition, order])


def unit_above(lines: DataFrame, *, document: str = "doc_id", order: str = "line_no", text: str = "line", within: int = 3, nearest: bool = True) -> DataFrame:
    """``unit``: the unit named in brackets in one of the ``within`` lines above, the nearest (or farthest) one."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(-within, -1)
    near = F.filter(F.transform(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w), lambda t: F.regexp_extract(t, r"단위\s*[:：]?\s*([가-힣%]+)", 1)), lambda u: u != "")
    return lines.withColumn("_units", near).withColumn("unit", F.try_element_at("_units", F.lit(-1 if nearest else 1))).drop("_units")


def rows_between(df: DataFrame, order: list[str | Column], *, offset: int = 0, most: int | None = None) -> DataFrame:
    """``most`` rows from place ``offset`` in the order, which should be total; rows of equal keys are taken by chance."""
    rows = df.orderBy(*order).offset(offset)
    return rows if most is None else rows.limit(most)
