"""A stored vector index: cells around k-means centres, one byte a component, probing and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.functions.vectors import cosine
from brinework.operators.search import batch_topk, best_rows

#: Rows that centres are fitted on at most, and bytes of all centres at most (they are broadcast).
SAMPLE_ROWS, CENTRE_BYTES = 200_000, 64_000_000
#: Rows of a cell in one part, and vectors on which the number of probed cells is measured.
PART_ROWS, MEASURED = 50_000, 200


@dataclass
class Cells:
    """rows: (cell, part, id, scale, code, vector), centres: (cell, parts, centre); ``probes`` cells are searched for each query."""

    rows: DataFrame
    centres: DataFrame
    probes: int

    @staticmethod
    def open(spark: SparkSession, path: str) -> Cells:
        return Cells(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/probes").first()["probes"])


def units(lists: pa.Array) -> np.ndarray:
    """Vectors of one size as a matrix of rows of length 1; zero vectors stay."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _unit_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) with the vector at length 1."""
    for batch in batches:
        if batch.num_rows:
            m = units(batch.column(1))
            unit = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit], names=["id", "vector", "unit"])


def _coded(shared: Broadcast):
    """(cell, id, vector) with a scale, and what the vector is beside its centre in one byte a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rest = units(batch.column(2)) - shared.value[batch.column(0).to_numpy()]
                scale = np.abs(rest).max(1) / 127
                code = np.rint(rest / np.maximum(scale, 1e-300)[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scale), pa.array([c.tobytes() for c in code], pa.binary())], names=["cell", "id", "vector", "scale", "code"])

    return run


def build(embeddings: DataFrame, path: str, *, cells: int | None = None, recall: float = 0.95, k: int = 10, seed: int = 7, id_col: str = "vec_id", vector: str = "embedding") -> Cells:
    """Writes the index of ``embeddings`` to ``path`` and opens it.

    Vectors are taken at length 1.  Centres (``cells``, about the root of the
    number of rows) are fitted by distributed k-means on at most ``SAMPLE_ROWS``
    rows; every row is put into the cell of its nearest centre, with its rest
    coded in one byte a component.  The number of cells to search is measured:
    the least that hold a share ``recall`` of the ``k`` nearest neighbours, found
    exactly, of ``MEASURED`` rows.  Null and zero vectors and those with null
    components are not indexed; all others have the same length.
    """
    spark = embeddings.sparkSession
    usable = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()) & F.exists(vector, lambda x: x != 0)
    kinds = dict(embeddings.dtypes)
    rows = embeddings.where(usable).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    rows = rows.mapInArrow(_unit_column, f"id {kinds[id_col]}, vector {kinds[vector]}, unit array<double>")
    count, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("unit")), F.lit(1))).first()
    cells = cells or max(1, int(count**0.5))
    if cells * size * 8 > CENTRE_BYTES:
        raise ValueError(f"{cells} centres of {size} components take more than {CENTRE_BYTES} bytes")
    share = min(1.0, SAMPLE_ROWS / max(1, count))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, featuresCol="features", predictionCol="cell").fit(rows.sample(share, seed).select(array_to_vector("unit").alias("features"))) if count > 1 else None
    points = [c.tolist() for c in model.clusterCenters()] if model else [[0.0] * size]
    centres = spark.createDataFrame(list(enumerate(points)), "cell int, centre array<double>")
    placed = model.transform(rows.withColumn("features", array_to_vector("unit"))).drop("features") if model else rows.withColumn("cell", F.lit(0))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    centres.join(sizes, "cell").select("cell", "parts", "centre").write.mode("overwrite").parquet(f"{path}/centres")
    centres = spark.read.parquet(f"{path}/centres")
    coded = placed.select("cell", "id", "vector").mapInArrow(_coded(spark.sparkContext.broadcast(np.array(points))), f"cell int, id {kinds[id_col]}, vector {kinds[vector]}, scale double, code binary")
    table = coded.join(F.broadcast(centres.select("cell", "parts")), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "scale", "code", "vector")
    table.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{path}/rows")
    index = Cells(spark.read.parquet(f"{path}/rows"), centres, 1)
    index.probes = measured_probes(index, recall, k)
    spark.createDataFrame([(index.probes,)], "probes int").write.mode("overwrite").parquet(f"{path}/probes")
    return index


def near_cells(queries: DataFrame, centres: DataFrame, probes: int | None) -> DataFrame:
    """(q, v, cell, place) of the ``probes`` cells whose centres are nearest to each query's vector, all cells for None."""
    found = centres.orderBy("cell").select("cell", "centre").collect()
    numbers, points = np.array([r.cell for r in found], np.int32), np.array([r.centre for r in found])
    shared = queries.sparkSession.sparkContext.broadcast((numbers, points, (points**2).sum(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, points, squares = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            v = units(lists)
            order = np.argsort(squares - 2 * (v @ points.T), axis=1, kind="stable")[:, :probes]
            row, place = np.repeat(np.arange(len(v)), order.shape[1]), np.tile(np.arange(order.shape[1], dtype=np.int32), len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), lists.take(pa.array(row)), pa.array(numbers[order.ravel()]), pa.array(place)], names=["q", "v", "cell", "place"])

    kind = dict(queries.dtypes)["q"]
    return queries.select("q", "v").mapInArrow(run, f"q {kind}, v array<double>, cell int, place int")


def measured_probes(index: Cells, recall: float, k: int) -> int:
    """The least number of cells in which a share ``recall`` of the k nearest neighbours of some rows lies."""
    some = index.rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).orderBy(F.xxhash64("id"), "id").limit(MEASURED)
    true = batch_topk(index.rows, some, k=k, id_col="id", vector="vector")
    wanted = true.join(index.rows.select("id", "cell"), "id").select(F.col("query_id").alias("q"), "cell")
    asked = some.select(F.col("query_id").alias("q"), F.col("query_vector").cast("array<double>").alias("v"))
    places = near_cells(asked, index.centres, None).join(wanted, ["q", "cell"]).groupBy("place").agg(F.count("*").alias("n")).collect()
    total, seen = sum(r.n for r in places), 0
    for r in sorted(places):
        seen += r.n
        if seen >= recall * total:
            return r.place + 1
    return 1


def topk(index: Cells, queries: DataFrame, *, k: int = 10, probes: int | None = None, wider: int = 4, id_col: str = "vec_id", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest found in the ``probes`` nearest cells of each query.

    Coded vectors are compared first; of the ``wider`` times k best of each
    query the similarity is worked out exactly.  Null, empty and zero query
    vectors have no rows.
    """
    kind, name_kind = dict(index.rows.dtypes)["id"], dict(queries.dtypes)[query_id]
    asked = queries.where((F.size(query_vector) > 0) & ~F.exists(query_vector, lambda x: x.isNull()) & F.exists(query_vector, lambda x: x != 0))
    asked = asked.select(F.col(query_id).cast("string").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    seats = near_cells(asked, index.centres, probes or index.probes).join(F.broadcast(index.centres.select("cell", "parts")), "cell")
    seats = seats.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    centres = F.broadcast(index.centres.select("cell", "centre"))
    some = index.rows.join(F.broadcast(seats.select("cell").distinct()), "cell", "left_semi").select("cell", "part", "id", "scale", "code").join(centres, "cell")

    def compare(found: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, names = found["id"].to_pylist(), wanted["q"].to_pylist()
        best = []
        if ids and names:
            codes = np.frombuffer(b"".join(found["code"].to_pylist()), np.int8).astype(np.float64).reshape(len(ids), -1)
            near = codes * found["scale"].to_numpy()[:, None] + np.array(found["centre"][0].as_py())
            best = list(best_rows(names, wanted["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1), ids, near, wider * k))
        columns = zip(*best, strict=True) if best else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), found.schema.field("id").type, pa.float64()), strict=True)], names=["q", "id", "near"])

    close = some.groupBy("cell", "part").cogroup(seats.select("cell", "part", "q", "v").groupBy("cell", "part")).applyInArrow(compare, f"q string, id {kind}, near double")
    close = close.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))).where(F.col("place") <= wider * k)
    exact = close.select("q", "id").join(index.rows.select("id", "vector"), "id").join(asked, "q").select("q", F.col("id").alias(id_col), cosine("vector", "v").alias("similarity"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), id_col))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").cast(name_kind).alias(query_id), "rank", id_col, "similarity")
