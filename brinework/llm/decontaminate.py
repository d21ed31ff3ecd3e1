"""Benchmark decontamination by spaced-seed hashing.

Only DataFrame functions are used.  A mask reads some token positions and
ignores the others, so a hit survives substituted words at ignored positions;
the masks back each other up.  Hits of training and test hashes are joined, and
the overlap around each hit is verified word by word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm._shared import PREFIX, materialize

#: Token positions that count, for each mask.  In any run of 8 to 25
#: words of which a fifth is substituted at least one of these reads no substituted word.
MASKS = ("1111001", "111011", "10010111")
_SPLIT = r"[^\p{L}\p{N}]+"
#: Two hashes of a text; rows with equal texts are judged once.
A, B = PREFIX + "a", PREFIX + "b"


def token_hashes(text: Column) -> Column:
    """Hashes of the words: lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT, -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def short_masks(words: int, min_overlap: float) -> list[str]:
    """Masks for items of so few words, as long as the item.

    With k substitutions allowed the item is cut into k + 2 parts and each mask
    reads two of them: whichever words are substituted, two parts are whole.
    """
    allowed = int(words * (1 - min_overlap) + 1e-9)
    parts = min(allowed + 2, words)
    if not allowed or parts < 3:
        return ["1" * words]
    part_of = [i * parts // words for i in range(words)]
    return ["".join("1" if p in two else "0" for p in part_of) for two in combinations(range(parts), 2)]


def _seeds(rows: DataFrame, keep: list[str], masks: list[tuple[str, str]], whole: bool) -> DataFrame:
    """(keep, at, seed) rows: the hash of each (tag, mask) at each position of ``tokens``.

    With ``whole`` only masks that end within the tokens are read.
    """
    span = max(len(m) for _, m in masks)

    def seeds(x: Column) -> Column:
        found = []
        for tag, m in masks:
            seed = F.xxhash64(F.lit(tag), *[F.get(x, F.lit(j)) for j, c in enumerate(m) if c == "1"])
            found.append(F.when(F.size(x) >= len(m), seed) if whole else seed)
        return F.array(*found)

    last = F.size("tokens") - (min(len(m) for _, m in masks) if whole else 1)
    at = F.when(last >= 0, F.sequence(F.lit(0), last))
    pieces = F.transform(F.transform(at, lambda i: F.slice("tokens", i + 1, span)), seeds)
    return rows.select(*keep, F.posexplode(pieces).alias("at", "seeds")).select(*keep, "at", F.explode("seeds").alias("seed")).where("seed is not null")


def _windows(near: Column, width: Column, bits: int) -> Column:
    """Largest number of words, in any window of the item, that agree at one of the shifts in ``bits``."""
    hit = F.transform(near, lambda x: (x.bitwiseAND(F.lit(bits)) != 0).cast("int"))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(near) - width), lambda i: F.aggregate(F.slice(hit, i + 1, width), F.lit(0), lambda s, x: s + x)))


def _aligned(near: Column, width: Column, gap: int) -> Column:
    """Longest common subsequence of any window of the item and the document, within ``gap`` words of the shift."""
    n = 2 * gap + 1

    def step(acc: Column, same: Column) -> Column:
        reached = [F.get(acc, F.lit(d)) + F.shiftright(same, d).bitwiseAND(F.lit(1)) for d in range(n)]
        reached = [F.greatest(x, F.get(acc, F.lit(d + 1))) if d + 1 < n else x for d, x in enumerate(reached)]
        return F.array(*[F.greatest(*reached[: d + 1]) if d else reached[0] for d in range(n)])

    def window(i: Column) -> Column:
        return F.aggregate(F.slice(near, i + 1, width), F.array(*[F.lit(0)] * n), step, lambda acc: F.element_at(acc, -1))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(near) - width), window))


def text_keys(text: str) -> dict[str, Column]:
    return {A: F.xxhash64(F.col(text)), B: F.xxhash64(F.lit(7), F.col(text))}


def leaked_texts(docs: DataFrame, benchmark: DataFrame, *, min_overlap: float = 0.8, window: int = 25, gap: int = 3, masks: tuple[str, ...] = MASKS, broadcast_seeds: int = 1_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The distinct texts of ``docs`` that hold a benchmark passage, by their two hashes.

    Columns: the hashes, item_ids (sorted), n_items, overlap.  Described at
    :func:`contamination`.
    """
    least = max(map(len, masks))
    keyed = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), token_hashes(F.col(item_text)).alias("tokens"))
    tests = materialize(keyed.where(F.size("tokens") > 0).distinct().withColumn("item_no", F.monotonically_increasing_id()), "tests")
    # at most as many lengths as a mask is long
    lengths = sorted(r[0] for r in tests.where(F.size("tokens") < least).select(F.size("tokens")).distinct().collect())
    common = [(f"m{k}", m) for k, m in enumerate(masks)]
    special = {n: [(f"{n}.{k}", m) for k, m in enumerate(short_masks(n, min_overlap))] for n in lengths}
    seeds = _seeds(tests.where(F.size("tokens") >= least), ["item_no"], common, True)
    for n, own in special.items():
        seeds = seeds.unionAll(_seeds(tests.where(F.size("tokens") == n), ["item_no"], own, True).where("at = 0"))
    seeds = materialize(seeds.withColumnRenamed("at", "item_at").distinct(), "seeds")
    small = seeds.count() <= broadcast_seeds
    side = F.broadcast(seeds) if small else seeds
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).withColumns(text_keys("text"))
    read = rows.select(A, B, token_hashes(F.col("text")).alias("tokens"))
    every = common + [m for own in special.values() for m in own]
    hits = _seeds(read, [A, B], every, False).join(side, "seed")
    hits = hits.select(A, B, "item_no", (F.col("at") - F.col("item_at")).alias("shift"), F.floor(F.col("item_at") / window).cast("int").alias("block")).distinct()
    hits = materialize(hits, "hits")
    texts = hits.select(A, B).distinct()
    found = rows.join(F.broadcast(texts) if texts.count() <= 200_000 else texts, [A, B], "left_semi").dropDuplicates([A, B])
    found = found.select(A, B, token_hashes(F.col("text")).alias("tokens"))
    dims = tests.select("item_no", F.col("tokens").alias("item"))
    pairs = hits.join(found, [A, B]).join(F.broadcast(dims) if small else dims, "item_no")
    # only the windows that hold a hit of the block are looked at: as many words for a long item as for a short one
    size = F.size("item")
    width = F.least(F.lit(window), size)
    begin = F.greatest(F.lit(0), F.col("block") * window - width + 1)
    stop = F.least(size - width, F.col("block") * window + (window - 1)) + width
    low = F.greatest(F.lit(0), F.col("shift") + begin - gap)
    pairs = pairs.select(A, B, "item_no", width.alias("width"), F.slice("item", begin + 1, stop - begin).alias("part"), F.slice("tokens", low + 1, F.greatest(F.lit(0), F.col("shift") + stop + gap - low)).alias("words"), (F.col("shift") + begin - low).alias("off"))

    def bits(w: Column, j: Column) -> Column:
        out = F.lit(0)
        for d in range(-gap, gap + 1):
            out = out + F.when(F.get("words", F.col("off") + j + d) == w, 1 << (d + gap)).otherwise(0)
        return out

    near = materialize(pairs.select(A, B, "item_no", "width", F.transform("part", bits).alias("near")).distinct(), "near")
    need = F.ceil(F.col("width") * min_overlap - 1e-9)
    counted = near.withColumns({"straight": _windows(F.col("near"), F.col("width"), 1 << gap), "bound": _windows(F.col("near"), F.col("width"), (1 << (2 * gap + 1)) - 1)})
    # no alignment has more words than agree at any of its shifts
    counted = materialize(counted.where(F.col("bound") >= need), "counted")
    same = counted.where(F.col("straight") >= need).withColumn("best", F.col("straight"))
    moved = counted.where(F.col("straight") < need).withColumn("best", _aligned(F.col("near"), F.col("width"), gap)).where(F.col("best") >= need)
    items = same.unionAll(moved).groupBy(A, B, "item_no").agg(F.max(F.col("best") / F.col("width")).alias("overlap"))
    items = items.join(F.broadcast(tests.select("item_no", "item_id")) if small else tests.select("item_no", "item_id"), "item_no")
    return items.groupBy(A, B).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_items"), F.max("overlap").alias("overlap"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Documents that contain a passage of a benchmark item.

    Returns doc_id, item_ids (sorted), n_items, overlap (largest share of
    agreeing words), one row for each hit row of ``docs``: repeated rows come
    back as often as they stand there, rows without an id too.

    A document is hit when, aligned at a seed hit, at least ``min_overlap`` of
    the words agree in some window of the item: ``window`` words, or the whole
    item where it is shorter.  So the shortest partial quote that counts has 20
    words of an item of 25 or more; items of four words or less must be quoted
    whole.  Substituted words count as disagreeing; with the masks given here
    no pattern of substitutions escapes the seeds.  Where words are inserted or
    left out, the words that follow agree at a shift up to ``gap`` words away;
    where no single shift suffices, words of all these shifts are added up, in
    order.  Null, empty and wordless texts and items are never hit; items that
    share an id are told apart; an item without an id counts in n_items only.
    No alignment is capped, and each is verified in windows around its hits, so
    the work is linear in the length of an item.

    Rows with equal texts are judged once.  The benchmark's hashes are broadcast
    if a count shows at most ``broadcast_seeds`` of them, else joined by a
    shuffle on the hash.  ``how``: see :func:`leaked_texts`.
    """
    leaks = materialize(leaked_texts(docs, benchmark, text=text, **how), "leaks")
    few = leaks.count() <= 100_000
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumns(text_keys("text")).drop("text")
    return rows.join(F.broadcast(leaks) if few else leaks, [A, B]).drop(A, B)


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that :func:`contamination` finds, all columns kept; null texts stay."""
    leaks = materialize(leaked_texts(docs, benchmark, text=text, **how).select(A, B), "leaks")
    few = leaks.count() <= 200_000
    return docs.withColumns(text_keys(text)).join(F.broadcast(leaks) if few else leaks, [A, B], "left_anti").select(docs.columns)
