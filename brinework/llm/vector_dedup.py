"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again at the median of a random
projection.  Vectors near a split go to both sides, so a close pair is rarely
parted, and the trees are drawn independently.  A round of splitting is fitted
in the tasks on a sample of each open leaf and applied to all of its rows;
rounds go on until leaves are small, or so dense that a split would put most
rows on both sides.  All pairs of a leaf are compared, a large leaf in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.llm import _bytes as B
from brinework.llm._shared import PREFIX, grown, integer_id, materialize
from brinework.llm.components import connected_components

#: Levels of one round, rows of a leaf's sample, and the fewest of them that are split.
LEVELS, SAMPLE, LEAST = 7, 4096, 64
#: Random directions to choose from; a leaf whose best split doubles more than this share is dense and stays.
CHOICES, DENSE = 3, 0.5
#: Rows of a block; two blocks are compared in one task.  Rows compared in one task.
BLOCK_ROWS, TASK_ROWS = 2048, 20_000
#: Cosines so near the threshold are worked out again, with sums that are rounded once.
DOUBT = 1e-9
ID, VEC = PREFIX + "vec_id", PREFIX + "vec"


def unit_rows(column: pa.Array) -> list[np.ndarray]:
    """The vectors of an Arrow list column, in doubles and of length 1."""
    values, cuts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x = values[a:b] / np.abs(values[a:b]).max()
        out.append(x / math.sqrt(x @ x))
    return out


def directions(leaf: int, node: int, dim: int) -> np.ndarray:
    """The CHOICES random directions of one node of a leaf's subtree, as columns of length 1."""
    seed = B.mix(np.array([leaf & 0xFFFFFFFFFFFFFFFF], np.uint64) ^ B.mix(np.array([~node & 0xFFFFFFFFFFFFFFFF], np.uint64)))
    bits = B.mix(seed + np.arange(1, dim * CHOICES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    out = (bits >> np.uint64(11)).astype(np.float64).reshape(dim, CHOICES) / 2.0**53 - 0.5
    return out / np.sqrt((out * out).sum(0))


def margin(threshold: float, dim: int, spill: float) -> float:
    """Half the width of the strip around a split whose rows go to both sides.

    Two vectors at the threshold differ along a random direction by
    sqrt(2 (1 - threshold) / dim) on average (root of the mean square); ``spill``
    times that is the strip.
    """
    return spill * math.sqrt(max(0.0, 2 * (1 - threshold)) / dim) / 2


def fit_leaf(leaf: int, rows: np.ndarray, total: int, leaf_rows: int, half: float) -> tuple[list[float], list[int]]:
    """A subtree of a leaf by a sample of its ``total`` rows: threshold and chosen direction of each node, in heap order.

    A node without a split has no threshold (NaN); -1 instead of a direction
    says that its rows lie too dense to be split.
    """
    places = (1 << LEVELS) - 1
    cut, choice = [math.nan] * places, [0] * places
    queue = [(0, np.arange(len(rows)))]
    for node, inside in queue:
        if len(inside) * total <= leaf_rows * len(rows) or len(inside) < LEAST:
            continue
        seen = rows[inside] @ directions(leaf, node, rows.shape[1])
        middle = np.median(seen, axis=0)
        both = (np.abs(seen - middle) <= half).mean(0)
        best = int(both.argmin())
        if both[best] > DENSE:
            choice[node] = -1
            continue
        cut[node], choice[node] = float(middle[best]), best
        for child, side in ((2 * node + 1, seen[:, best] <= middle[best] + half), (2 * node + 2, seen[:, best] >= middle[best] - half)):
            if child < places:
                queue.append((child, inside[side]))
    return cut, choice


def route_leaf(leaf: int, rows: np.ndarray, cut: np.ndarray, choice: np.ndarray, half: float) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Where rows end in a leaf's subtree: number of the node, whether it is dense, and the rows; a row may end in several."""
    queue = [(0, np.arange(len(rows)))]
    for node, inside in queue:
        if not len(inside):
            continue
        if node >= len(cut) or math.isnan(cut[node]):
            yield node, node < len(cut) and choice[node] < 0, inside
            continue
        seen = rows[inside] @ directions(leaf, node, rows.shape[1])[:, choice[node]]
        queue.append((2 * node + 1, inside[seen <= cut[node] + half]))
        queue.append((2 * node + 2, inside[seen >= cut[node] - half]))


def _fit(leaf_rows: int, threshold: float, spill: float):
    def run(group: pa.Table) -> pa.Table:
        rows = np.array(unit_rows(group["vec"].combine_chunks()))
        leaf = group["leaf"][0].as_py()
        cut, choice = fit_leaf(leaf, rows, group["n"][0].as_py(), leaf_rows, margin(threshold, rows.shape[1], spill))
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "cut": pa.array([cut], pa.list_(pa.float64())), "choice": pa.array([choice], pa.list_(pa.int32()))})

    return run


def _route(threshold: float, spill: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            leaves, ids, units = col["leaf"].to_numpy(), col["id"].to_numpy(), unit_rows(col["vec"])
            order = np.argsort(leaves, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
                if not len(part):
                    continue
                leaf, first = int(leaves[part[0]]), int(part[0])
                rows = np.array([units[i] for i in part])
                cut, choice = (np.array(col[c][first].as_py()) for c in ("cut", "choice"))
                for node, dense, inside in route_leaf(leaf, rows, cut, choice, margin(threshold, rows.shape[1], spill)):
                    name = B.mix(np.array([leaf & 0xFFFFFFFFFFFFFFFF], np.uint64) ^ B.mix(np.array([node + 1], np.uint64))).view(np.int64)[0]
                    n = len(inside)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part[inside]]), pa.array(np.full(n, name)), pa.array(np.full(n, dense))], names=["id", "leaf", "dense"])

    return run


def forest_leaves(classes: DataFrame, *, threshold: float, trees: int, leaf_rows: int, spill: float, max_rounds: int) -> DataFrame:
    """(id, leaf) of each vector of ``classes`` (id, vec): the leaves of all trees that it lies in.

    Names of leaves differ between trees and dimensions.  A leaf of more than
    twice ``leaf_rows`` rows is split in another round, unless it is dense.
    """
    tree = F.explode(F.sequence(F.lit(1), F.lit(trees)))
    places = classes.select("id", F.size("vec").alias("dim"), tree.alias("tree")).select("id", F.xxhash64("tree", "dim").alias("leaf"), F.lit(False).alias("dense"))
    places, out = materialize(places, "places"), None
    for k in range(max_rounds + 1):
        sizes = places.groupBy("leaf").agg(F.count("*").alias("n"), F.bool_or("dense").alias("stays"))
        share = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / SAMPLE))
        large = materialize(sizes.where((F.col("n") > 2 * leaf_rows) & ~F.col("stays")).select("leaf", "n", share.alias("share")), "open")
        count = large.count() if k < max_rounds else 0
        ended = places.join(F.broadcast(large.select("leaf")) if count <= 100_000 else large.select("leaf"), "leaf", "left_anti") if count else places
        ended = ended.select("id", "leaf")
        out = ended if out is None else out.unionAll(ended)
        if not count:
            return out
        rows = places.join(F.broadcast(large) if count <= 100_000 else large, "leaf").join(classes.select("id", "vec"), "id")
        sample = rows.where(F.pmod(F.xxhash64("id", "leaf"), F.col("share")) == 0).select("leaf", "n", "vec")
        plans = materialize(sample.groupBy("leaf").applyInArrow(_fit(leaf_rows, threshold, spill), "leaf long, cut array<double>, choice array<int>"), "plans")
        # a plan takes some 1.5 kB
        rows = rows.select("id", "leaf", "vec").join(F.broadcast(plans) if count <= 10_000 else plans, "leaf")
        places = materialize(rows.mapInArrow(_route(threshold, spill), "id long, leaf long, dense boolean"), "places")
    return out


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in x, j in y) of the pairs with a cosine of the threshold or more; of one block with itself i < j."""
    found = []
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ y.T
        i, j = np.nonzero(near >= threshold - DOUBT)
        values = near[i, j]
        i = i + a
        if same:
            values, i, j = values[i < j], i[i < j], j[i < j]
        good = values >= threshold
        for k in np.flatnonzero(np.abs(values - threshold) <= DOUBT):
            good[k] = exact_cosine(x[i[k]], y[j[k]]) >= threshold
        found.append((i[good].astype(np.int32), j[good].astype(np.int32)))
    return tuple(np.concatenate(c) if found else np.empty(0, np.int32) for c in zip(*found, strict=True))


def owned(i: np.ndarray, j: np.ndarray, leaf: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether ``leaf`` is the smallest leaf that both of a pair lie in, so that it alone counts the pair.

    first, second: the smaller leaves of each row, as numbers from 1, 0 for none.
    """
    good = np.ones(len(i), bool)
    step = max(1, 4_000_000 // max(1, first.shape[1] * second.shape[1]))
    for a in range(0, len(i), step):
        x, y = first[i[a : a + step]], second[j[a : a + step]]
        good[a : a + step] = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] > 0)).any((1, 2))
    return good


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it is connected to by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _smaller_leaves(lists: list[list[int]], leaf: int) -> np.ndarray:
    """Leaves below ``leaf`` that several rows lie in, numbered from 1: one line for each row, filled with 0."""
    flat = np.concatenate([np.array(x, np.int64) for x in lists])
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    keep = flat < leaf
    flat, row = flat[keep], row[keep]
    names, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[number] > 1
    number, row = number[keep] + 1, row[keep]
    counts = np.bincount(row, minlength=len(lists))
    out = np.zeros((len(lists), max(1, int(counts.max(initial=0)))), np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = number
    return out


def _compare(threshold: float):
    """Rows sorted by tile; yields (id, root, links): the pairs that the tile's leaf owns, summed by row, and a row each is connected to."""

    def tile(key: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[:2])
        same = key[1] == key[2]
        ids, weights = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        units = np.array([r[4] for r in rows])
        middle = 0 if same else sum(r[0] == key[1] for r in rows)
        i, j = near_pairs(units if same else units[:middle], units[middle:], threshold, same)
        j = j + middle
        if len(i):
            smaller = _smaller_leaves([r[3] for r in rows], key[0])
            good = owned(i, j, key[0], smaller, smaller)
            i, j = i[good], j[good]
        if not len(i):
            return None
        links = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[roots(len(ids), i, j)[some]]), pa.array(links[some].astype(np.int64))], names=["id", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tile, rows = None, []
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            units = unit_rows(col["vec"])
            for n, row in enumerate(zip(*(col[c].to_pylist() for c in ("leaf", "x", "y", "side", "id", "weight", "leaves")), strict=True)):
                if row[:3] != open_tile:
                    if len(rows) > 1 and (out := tile(open_tile, rows)) is not None:
                        yield out
                    open_tile, rows = row[:3], []
                rows.append((*row[3:], units[n]))
        if len(rows) > 1 and (out := tile(open_tile, rows)) is not None:
            yield out

    return run


def leaf_links(classes: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(id, root, links): links of ``classes`` (id, weight, vec) within the leaves of ``places``, each pair counted once.

    A leaf of more than BLOCK_ROWS rows is cut into blocks, and pairs of blocks
    are compared in different tasks.
    """
    sizes = places.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    seated = materialize(places.join(sizes, "leaf"), "seats")
    lists = seated.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    rows = materialize(classes.select("id", "weight", "vec").join(lists, "id"), "rows")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    seats = seated.select("id", "leaf", blocks.alias("blocks")).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seats = seats.select("id", "leaf", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))
    tasks = grown(seated.select(F.sum(F.ceil(F.col("n") / BLOCK_ROWS))).first()[0] or 0, 16, TASK_ROWS)
    dealt = seats.join(rows, "id").repartition(tasks, "leaf", "x", "y").sortWithinPartitions("leaf", "x", "y")
    return materialize(dealt.mapInArrow(_compare(threshold), "id long, root long, links long"), "linked")


def vector_dedup(
    vectors: DataFrame, *, threshold: float = 0.95, trees: int = 8, leaf_rows: int = 512, spill: float = 1.0, max_rounds: int = 12, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Every vector with its number of links, its component, and whether it stands for it: vec_id, n_links, component_id, kept.

    A link joins two vectors of the same number of components whose cosine is
    ``threshold`` or more, worked out in doubles; none is linked below it.  n_links
    counts other rows linked directly, copies among them; component_id is the
    smallest id reachable over links; kept says that the row bears it.

    Null, empty and zero vectors, and those with null, infinite or NaN
    components, are linked to nothing.  Rows without an id take part; an id is
    null where no row of the component has one.  Repeated rows count one by one
    and are kept together.  Other columns are ignored.  An empty table gives an
    empty result.  Ids are integers.

    Equal vectors are one class from the start.  A pair at the threshold is
    parted at one split with a chance of some 2 per cent, so one tree of ten
    splits finds it with 0.8, and eight with 0.99999; nearer pairs more often.
    Every class is in every tree.  A group of g different vectors near each
    other is compared pair by pair (in blocks over many tasks), since its links
    are counted exactly; no pair is shuffled.
    """
    rows = vectors.select(integer_id(vectors, vec_id).alias(ID), F.col(embedding).alias(VEC))
    if not isinstance(rows.schema[VEC].dataType.elementType, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn(VEC, F.col(VEC).cast("array<double>"))
    usable = F.forall(VEC, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(VEC, lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable")
    classes = good.groupBy(VEC).agg(F.min(ID).alias("low"), F.count("*").alias("weight"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "low", "weight", F.col(VEC).alias("vec")), "classes")
    places = forest_leaves(classes, threshold=threshold, trees=trees, leaf_rows=leaf_rows, spill=spill, max_rounds=max_rounds)
    linked = leaf_links(classes, places, threshold)
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(linked.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    facts = materialize(classes.select("id", "low", "weight", "vec").join(counts.join(groups.withColumnRenamed("node", "id"), "id"), "id", "left"), "facts")
    lowest = facts.where("component is not null").groupBy("component").agg(F.min("low").alias("component_low"))
    facts = facts.join(lowest, "component", "left").select(F.col("vec").alias(VEC), "links", "weight", F.coalesce("component_low", "low").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long")
    out = good.join(facts, VEC).select(ID, n_links.alias("n_links"), "component_id")
    alone = rows.where(~F.col("usable")).select(ID, F.lit(0).cast("long").alias("n_links"), F.col(ID).alias("component_id"))
    return out.unionAll(alone).select(F.col(ID).alias("vec_id"), "n_links", "component_id", F.col(ID).eqNullSafe(F.col("component_id")).alias("kept"))
