"""Self-join on the Jaccard similarity of word n-grams by a MinHash LSH forest.

Each class of equal n-gram sets has one label of MinHash values for each tree.
A tree is its sorted labels: classes below one trie node stand side by side.
The forest is sorted once, in ranges of labels, so a node with a third of all
classes is spread over many tasks; nodes at any depth are runs of a common
prefix in the sorted table.  How far prefixes are shortened is decided by the
links that all classes have at full depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import _bytes as B
from brinework.llm._shared import PREFIX, grown, integer_id, materialize
from brinework.llm.components import connected_components
from brinework.llm.exact_dedup import COUNT, GROUP, HIGH, ID, KEY, LOW, RUN, RUN_ROWS, RUNS, SIZE, power_of_two, resolve, run_of, smallest

#: A block holds about so many documents and n-grams; two blocks are compared in one task.
BLOCK_ROWS, BLOCK_GRAMS = 128, 400_000
#: Rows of the sorted forest in one range, and tiles of one task, beyond which there are more.
RANGE_ROWS, TASK_TILES = 500_000, 16
#: Steps of similarity in which links are counted.
STEPS = 64
#: Steps by which classes look for a common home; any homes give right results, common ones fewer tasks.
HOME_ROUNDS = 2


def found_share(similarity: float, trees: int, depth: int) -> float:
    """Probability that a pair shares a prefix of ``depth`` values in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(counts: dict[float, float], trees: int, depth: int, recall: float) -> int:
    """The longest prefix that finds a share ``recall`` of the links.

    counts: links by similarity, as found at full depth.  Each stands for
    1 / found_share links, so what full depth misses is added; the prefix is
    shortened from ``depth`` until the expected recall is met.
    """
    real = {s: n / found_share(s, trees, depth) for s, n in counts.items() if n}
    total, k = sum(real.values()), depth
    while k > 1 and sum(n * found_share(s, trees, k) for s, n in real.items()) < recall * total:
        k -= 1
    return k


def row_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted, and each row's range.

    Words are blank-parted, A-Z lower-cased.  A row of fewer than n words has
    one n-gram of all its words; a row without words has none.
    """
    low = B.LOWER[data]
    starts, ends, rows = B.word_spans(low, offsets)
    words = B.span_hashes(low, starts, ends)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(B.gram_hashes(words[a:b], n)))
        else:
            out.append(B.gram_hashes(words[a:b], b - a) if b > a else words[:0])
    sizes = [len(x) for x in out]
    return np.concatenate(out) if out else words[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4711)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def signatures(grams: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) MinHash values of 32 bits; rows without n-grams get the largest."""
    full = np.flatnonzero(np.diff(rows))
    out = np.full((len(rows) - 1, count), 0xFFFFFFFF, np.uint32)
    a, b = _factors(count)
    edges = rows[full]
    step = 1 << 16
    if not len(full):
        return out
    # blocks of rows keep the products in the processor's cache
    first = 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + step)))
        low = edges[first]
        high = rows[full[last - 1] + 1]
        part, cuts = grams[low:high], edges[first:last] - low
        for k in range(count):
            out[full[first:last], k] = np.minimum.reduceat(((part * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), cuts)
        first = last
    return out


def _describe(n: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(batch.schema.get_field_index("text")))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in (ID, "text_key")]
            for a, b in B.blocks(offsets):
                grams, rows = row_grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                keys = pa.array([hashlib.blake2b(grams[x:y].tobytes(), digest_size=16).digest() for x, y in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)], pa.binary())
                marks = signatures(grams, rows, trees * depth)
                raw = np.ascontiguousarray(marks).astype(">u4")
                cuts = np.arange(0, raw.nbytes + 1, 4 * depth, dtype=np.int32)
                labels = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw.tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(marks) * trees + 1, trees, dtype=np.int32)), labels)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in keep), keys, pa.array(np.diff(rows)), lists], names=[ID, "text_key", KEY, SIZE, "labels"])

    return run


def _node_names(trees: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each (tree, prefix); one that two nodes share only adds candidates."""
    h = B.mix(trees.astype(np.uint64) + np.uint64(1))
    for column in np.ascontiguousarray(prefixes).view(">u4").T:
        h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return h.view(np.int64)


def _nodes(used: int):
    """Runs of rows, sorted by (tree, label), that share a prefix of ``used`` values.

    Rows with ``id`` are members of a node of two or more, with the first id of
    the run as hub.  The first and the last run of a range may go on in another
    range: their members come in any case, and beside them a row without ``id``
    that has the number of members in this range.  One row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("hub", pa.int64()), ("n", pa.int64())])

        def rows(nodes, ids, hubs, counts) -> pa.RecordBatch:
            n = len(nodes)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(n, pa.int64()) if ids is None else pa.array(ids), pa.array(hubs), pa.nulls(n, pa.int64()) if counts is None else pa.array(counts)], schema=out_schema)

        # the open run: its key, node, hub, rows given out so far, whether it is the first of its range, and its only row if not given out
        key, node, hub, given, first, held = None, 0, 0, 0, True, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts, trees, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("part", "tree", "id"))
            labels = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("label")).to_pylist()), np.uint8).reshape(n, -1)[:, : 4 * used]
            new = np.ones(n, bool)
            new[1:] = (parts[1:] != parts[:-1]) | (trees[1:] != trees[:-1]) | (labels[1:] != labels[:-1]).any(1)
            new[0] = key != (int(parts[0]), int(trees[0]), labels[0].tobytes())
            starts = np.flatnonzero(new)
            # run 0 is the open one, the others begin in this batch
            of = np.cumsum(new)
            nodes = np.concatenate([[node], _node_names(trees[starts], labels[starts])]).astype(np.int64)
            hubs = np.concatenate([[hub], ids[starts]]).astype(np.int64)
            sizes = np.bincount(of, minlength=len(nodes))
            sizes[0] += given + held
            places = np.concatenate([[key[0] if key else -1], parts[starts]])
            firsts = np.concatenate([[first], places[1:] != places[:-1]])
            lasts = np.concatenate([places[1:] != places[:-1], [False]])
            edge = firsts | lasts
            edge[-1] = False
            if key is None:
                edge[0] = False
            keep = (sizes > 1) | edge
            if held and keep[0]:
                yield rows(nodes[:1], hubs[:1], hubs[:1], None)
                given, held = given + 1, False
            picked = np.flatnonzero(keep[of])
            if len(picked):
                yield rows(nodes[of[picked]], ids[picked], hubs[of[picked]], None)
            some = np.flatnonzero(edge)
            if len(some):
                yield rows(nodes[some], None, hubs[some], sizes[some])
            if len(starts):
                last = starts[-1]
                key, node, hub, first = (int(parts[last]), int(trees[last]), labels[last].tobytes()), int(nodes[-1]), int(hubs[-1]), bool(firsts[-1])
                given, held = (int(sizes[-1]), False) if keep[-1] else (0, True)
            else:
                given = int(sizes[0]) - held
        if key is not None:
            one = np.array([node]), np.array([hub])
            if held:
                yield rows(one[0], one[1], one[1], None)
            yield rows(one[0], None, one[1], np.array([given + held]))

    return run


def trie_members(forest: DataFrame, used: int, ranges: int) -> DataFrame:
    """(node, id, hub) of all classes that share a prefix of ``used`` values with another one.

    forest: (part, tree, label, id), sorted by (tree, label, id) within each
    of the ``ranges`` parts.  Two rows for each range tell of nodes that lie in
    several; they are broadcast while there are at most 100,000 ranges.
    """
    runs = materialize(forest.mapInArrow(_nodes(used), "node long, id long, hub long, n long"), "runs")
    cut = runs.where("id is null").groupBy(F.col("node").alias("cut_node")).agg(F.sum("n").alias("n_all"), F.min("hub").alias("hub_all"))
    few = ranges <= 100_000
    rows = runs.where("id is not null").select("node", "id", "hub").join(F.broadcast(cut) if few else cut, F.col("node") == F.col("cut_node"), "left")
    return rows.where("n_all is null or n_all > 1").select("node", "id", F.coalesce("hub_all", "hub").alias("hub"))


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(batch.schema.get_field_index("text")))
            keep = [(name, batch.column(batch.schema.get_field_index(name))) for name in ("id", "weight", "home", "sub")]
            for a, b in B.blocks(offsets):
                grams, rows = row_grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                packed = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for _, c in keep), packed], names=[*(k for k, _ in keep), "grams"])

    return run


def tile_links(sets: list[np.ndarray], side: np.ndarray, same: bool, threshold: float) -> np.ndarray:
    """Matrix of similarities of pairs at or above the threshold, within one block or between two; 0 for all others.

    Only n-grams of two sets or more can add to an intersection; their
    incidence matrix is multiplied with itself, some columns at a time.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    grams = np.concatenate(sets) if count else np.empty(0, np.int64)
    owner = np.repeat(np.arange(count), sizes.astype(np.int64))
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(grams) else new
    owner, column = owner[shared], column[shared]
    inter = np.zeros((count, count), np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        step = 4096
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                grid = np.zeros((count, min(step, column[b - 1] - k * step + 1)), np.float32)
                grid[owner[a:b], column[a:b] - k * step] = 1
                inter += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - inter
    alike = inter / np.maximum(union, 1)
    near = (inter > 0) & (alike >= threshold)
    np.fill_diagonal(near, False)
    if not same:
        near &= side[:, None] != side[None, :]
    return np.where(near, alike, 0.0)


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of the matrix the smallest row it is connected to."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(label)).min(1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(threshold: float):
    """Rows sorted by tile; yields each linked document's counts and a document it is connected to.

    Rows without ``id`` tell the numbers of links by similarity (in STEPS steps, as ``root``).
    """

    def tile(rows: list[tuple]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[1])
        ids, weights = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        alike = tile_links([r[5] for r in rows], np.array([r[3] for r in rows]), rows[0][4], threshold)
        near = alike > 0
        some = np.flatnonzero(near.any(1))
        if not len(some):
            return None
        root, names = _forest(near), ["id", "root", "links", "class_links"]
        out = pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(near[some] @ weights), pa.array(near[some].sum(1))], names=names)
        steps = np.minimum(((alike[near] - threshold) / max(1 - threshold, 1e-9) * STEPS).astype(np.int64), STEPS - 1)
        steps, n = np.unique(steps, return_counts=True)
        told = pa.RecordBatch.from_arrays([pa.nulls(len(steps), pa.int64()), pa.array(steps), pa.array(n), pa.array(n)], names=names)
        return pa.Table.from_batches([out, told]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tile, rows = None, []
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            lists = cols["grams"]
            values, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            for i, row in enumerate(zip(*(cols[c].to_pylist() for c in ("tile", "id", "weight", "side", "same")), strict=True)):
                if row[0] != open_tile:
                    if len(rows) > 1 and (out := tile(rows)) is not None:
                        yield out
                    open_tile, rows = row[0], []
                rows.append((*row, values[cuts[i] : cuts[i + 1]].copy()))
        if len(rows) > 1 and (out := tile(rows)) is not None:
            yield out

    return run


def verified_links(found: DataFrame, reps: DataFrame, rows: DataFrame, *, n: int, threshold: float, broadcast_rows: int) -> DataFrame:
    """Candidates (node, id, hub) compared exactly: (id, root, links, class_links), and counts by similarity without an id.

    Similar classes get a common home, homes are cut into blocks, and blocks
    that meet below a node are compared, all pairs of the two at once.  Tiles
    are dealt to tasks in turn by falling size.
    """
    found = materialize(found, "candidates")
    # the smallest hub seen within a few steps below the nodes; each step is read once, so none is written
    homes = found.groupBy("id").agg(F.min("hub").alias("home"))
    for _ in range(HOME_ROUNDS):
        near = found.select("node", "id").join(homes, "id").groupBy("node").agg(F.min("home").alias("home"))
        homes = found.select("node", "id").join(near, "node").groupBy("id").agg(F.min("home").alias("home"))
    homes = materialize(homes.join(reps.select("id", "low", "text_key", "weight", "size"), "id"), "homes")
    room = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_GRAMS)).alias("subs"))
    placed = materialize(homes.join(room, "home").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs"))).drop("subs", "size"), "blocks")
    block = F.struct("home", "sub")
    meets = materialize(found.select("node", "id").join(placed.select("id", block.alias("block")), "id").select("node", "block").distinct(), "meets")
    across = meets.select("node", F.col("block").alias("x")).join(meets.select("node", F.col("block").alias("y")), "node").where(F.col("x") < F.col("y"))
    sizes = placed.groupBy("home", "sub").agg(F.count("*").alias("k")).select(block.alias("x"), "k")
    within = sizes.where("k > 1").select("x", F.col("x").alias("y"))
    pairs = across.select("x", "y").distinct().unionAll(within)
    pairs = pairs.join(sizes, "x").join(sizes.select(F.col("x").alias("y"), F.col("k").alias("m")), "y")
    pairs = materialize(pairs.orderBy(F.desc(F.col("k") + F.col("m")), "x", "y").select("x", "y", F.monotonically_increasing_id().alias("tile")), "tiles")
    # tiles are dealt like cards, the largest first: place in the order modulo the number of tasks
    part = F.shiftright("tile", 33)
    ahead, total, n_placed = {}, 0, 0
    # one job counts the tiles of each part and, as part -1, the candidates
    for p, k in sorted(tuple(r) for r in pairs.select(part.alias("p")).unionAll(placed.select(F.lit(-1).cast("long"))).groupBy("p").count().collect()):
        if p < 0:
            n_placed = k
            continue
        ahead[p] = total
        total += k
    bases = found.sparkSession.createDataFrame(list(ahead.items()), "p long, base long")
    pairs = pairs.withColumn("p", part).join(F.broadcast(bases), "p")
    tasks = grown(total, 16, TASK_TILES)
    task = ((F.col("base") + F.col("tile").bitwiseAND(F.lit((1 << 33) - 1))) % tasks).cast("int")
    same = F.col("x") == F.col("y")
    one, two = (F.struct(F.col(c).alias("block"), F.lit(i).alias("side")) for i, c in enumerate(("x", "y")))
    seats = pairs.select("tile", task.alias("task"), same.alias("same"), F.explode(F.when(same, F.array(one)).otherwise(F.array(one, two))).alias("s"))
    seats = seats.select("tile", "task", "same", "s.side", "s.block.home", "s.block.sub")
    few = n_placed <= broadcast_rows
    named = placed.withColumnRenamed("text_key", "own_key")
    texts = rows.join(F.broadcast(named) if few else named, (F.col("text_key") == F.col("own_key")) & F.col(ID).eqNullSafe(F.col("low")))
    texts = texts.select("id", "weight", "home", "sub", "text").dropDuplicates(["id"])
    sets = texts.mapInArrow(_grams(n), "id long, weight long, home long, sub long, grams array<long>")
    tiles = sets.join(seats, ["home", "sub"]).select("task", "tile", "id", "weight", "side", "same", "grams")
    dealt = tiles.repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("tile")
    return materialize(dealt.mapInArrow(_compare(threshold), "id long, root long, links long, class_links long"), "linked")


def _joined(docs: DataFrame, *, n: int, threshold: float, trees: int, depth: int, recall: float, prefix: int | None, runs: int | None, broadcast_rows: int, doc_id: str, text: str) -> DataFrame:
    """:func:`ngram_join` with ``text_key``, the hash of the text."""
    key = F.xxhash64(F.col(text))
    rows = docs.select(integer_id(docs, doc_id).alias(ID), key.alias("text_key"), F.col(text).alias("text"))
    count = docs.count()
    runs = runs or power_of_two(grown(count, RUNS, RUN_ROWS))
    marks = rows.mapInArrow(_describe(n, trees, depth), f"`{ID}` long, text_key long, `{KEY}` binary, `{SIZE}` long, labels array<binary>")
    marks = materialize(marks.withColumn(RUN, run_of(runs)), "marks")
    # texts without n-grams form no class
    classes = resolve(marks.where(F.col(SIZE) > 0).select(ID, RUN, KEY, SIZE), runs=runs)
    classes = materialize(classes.select(RUN, KEY, SIZE, F.col(GROUP).alias("id"), smallest().alias("low"), F.col(COUNT).alias("weight")), "classes")
    reps = marks.join(classes, [RUN, KEY, SIZE]).where(F.col(ID).eqNullSafe(F.col("low"))).dropDuplicates(["id"])
    reps = materialize(reps.select("id", "low", "text_key", "weight", F.col(SIZE).alias("size"), "labels"), "reps")
    forest = reps.select("id", F.posexplode("labels").alias("tree", "label"))
    ranges = grown(count * trees, 16, RANGE_ROWS)
    forest = forest.repartitionByRange(ranges, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    forest = materialize(forest.withColumn("part", F.spark_partition_id()), "forest")
    how = {"n": n, "threshold": threshold, "broadcast_rows": broadcast_rows}
    used, linked = prefix, None
    if used is None:
        # the links of all classes at full depth, counted by similarity
        linked = verified_links(trie_members(forest, depth, ranges), reps, rows, **how)
        found = {threshold + (1 - threshold) * r["root"] / STEPS: r["n"] for r in linked.where("id is null").groupBy("root").agg(F.sum("links").alias("n")).collect()}
        # without a link, recall at the threshold itself decides
        used = matched_depth(found or {threshold: 1.0}, trees, depth, recall)
        linked = linked if used == depth else None
    if linked is None:
        linked = verified_links(trie_members(forest, used, ranges), reps, rows, **how)
    linked = linked.where("id is not null")
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    groups = connected_components(linked.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    facts = materialize(counts.join(groups.withColumnRenamed("node", "id"), "id").join(reps.select("id", "low"), "id"), "facts")
    best = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "id")).alias("best")
    heads = materialize(facts.groupBy("component").agg(best).select("component", F.col("best.low").alias("group_low"), F.col("best.id").alias("head")), "heads")
    facts = facts.drop("low").join(heads, "component")
    answer = classes.join(facts, "id", "left")
    out = marks.select(ID, "text_key", RUN, KEY, SIZE).join(answer, [RUN, KEY, SIZE], "left")
    alone, linked = F.col("id").isNull(), F.col("head").isNotNull()
    return out.select(
        F.col(ID).alias("doc_id"),
        F.when(alone, F.col(ID)).otherwise(F.col("low")).alias("class_id"),
        F.coalesce("weight", F.lit(1)).cast("long").alias("class_size"),
        F.when(alone, F.col(ID)).when(linked, F.col("group_low")).otherwise(F.col("low")).alias("group_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_class_links"),
        (alone | ((~linked | (F.col("head") == F.col("id"))) & F.col(ID).eqNullSafe(F.col("low")))).alias("kept"),
        "text_key",
    )


def ngram_join(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 8, recall: float = 0.9995, prefix: int | None = None, runs: int | None = None, broadcast_rows: int = 300_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its class, its group and its number of links.

    A link joins two documents whose sets of word n-grams have a Jaccard
    similarity of ``threshold`` or more.  Returns one row per row of ``docs``:
    doc_id; class_id, the smallest id with the same n-grams; class_size;
    group_id, the smallest id reachable over links; n_links, other rows it is
    linked to (copies count); n_class_links, other classes it is linked to;
    kept, true for the row that stands for its group.

    Null and empty texts have no n-grams and no links: each row is its own
    class.  Shorter texts than n words have one n-gram of all words.  Rows
    without an id take part; ids are null where no row of the class or group
    has one.  Rows that share an id but not their n-grams are told apart; rows
    that share both stand for their group together.  Ids are integers.
    Columns besides id and text are ignored.

    Equal sets collapse into a class first (a tree-merge, so a class may hold a
    third of all rows).  Each class has ``trees`` labels of ``depth`` MinHash
    values, sorted into tries; classes that share a prefix are candidates and
    are compared exactly.  All classes are compared at ``depth`` first; from the
    links found there the longest prefix is worked out that finds a share
    ``recall`` of all links, and where that is shorter, all are compared by it.
    ``prefix`` sets its length instead.  At most ``broadcast_rows`` candidate ids are broadcast to
    read their texts again; more are joined by a shuffle of the texts.
    """
    return _joined(docs, n=n, threshold=threshold, trees=trees, depth=depth, recall=recall, prefix=prefix, runs=runs, broadcast_rows=broadcast_rows, doc_id=doc_id, text=text).drop("text_key")


def without_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with the rows that stand for their group (see :func:`ngram_join`), all columns kept."""
    defaults = {"n": 5, "threshold": 0.8, "trees": 20, "depth": 8, "recall": 0.9995, "prefix": None, "runs": None, "broadcast_rows": 300_000}
    gone = _joined(docs, doc_id=doc_id, text=text, **(defaults | how)).where(~F.col("kept")).select(F.col("doc_id").alias(ID), F.col("text_key").alias(KEY))
    gone = materialize(gone.distinct(), "gone")
    few, mark = gone.count() <= 200_000, PREFIX + "mark"
    kept = docs.withColumn(mark, F.xxhash64(F.col(text)))
    return kept.join(F.broadcast(gone) if few else gone, (F.col(mark) == F.col(KEY)) & F.col(doc_id).eqNullSafe(F.col(ID)), "left_anti").select(docs.columns)
