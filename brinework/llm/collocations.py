"""Phrase collocations: n-grams of deduplicated pieces, counted out-of-core in DuckDB by hash bucket.

Equal pieces of text are one row with a multiplicity.  N-grams are counted
order by order.  A run of words that occurs ``min_count`` times is made of runs
that do, so each order leaves a bitmap of fixed size that tells the next one
which places are worth counting; a full bitmap spares less work, but loses nothing.
The parts of a candidate are looked up by requests that go to the bucket of the
part and back to the bucket that asked.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.llm import _bytes as B
from brinework.llm._shared import grown, materialize

PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
#: Words of one block, whose n-grams are counted before they are shuffled, and bytes of pieces a hash bucket.
BLOCK_WORDS, BUCKET_BYTES = 1_000_000, 24_000_000
#: Memory of DuckDB in a task; beyond it, it spills to a folder of the task that goes when the task ends.
DUCKDB_MB = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[32, 9]] = False


def pieces(docs: DataFrame, *, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, piece, m): distinct pieces with words, blanks between words made one space, and how often each occurs."""
    low = F.translate(F.col(text), UPPER, LOWER)
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(F.split(low, PIECE_ENDS)).alias("piece"))
    rows = rows.select("lang", F.trim(F.when(F.col("piece").rlike("\t|  "), F.regexp_replace("piece", "[ \t]+", " ")).otherwise(F.col("piece"))).alias("piece"))
    return rows.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def duckdb_sums(table: pa.Table | pa.RecordBatchReader, sql: str) -> Iterator[pa.RecordBatch]:
    """``sql`` over ``rows``, with bounded memory and a folder of its own for what goes beyond."""
    import duckdb

    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": f"{DUCKDB_MB}MB", "temp_directory": spill, "threads": 1, "preserve_insertion_order": False}) as con:
        con.register("rows", table)
        yield from con.sql(sql).to_arrow_reader(50_000)


def _lang_seeds(langs: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each row's place in the list of languages, that list, and a hash for each language."""
    coded = langs.dictionary_encode()
    names = coded.dictionary
    seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.to_pylist()]
    return coded.indices.to_numpy().astype(np.int64), names, np.array(seeds, np.uint64)


def marks(words: np.ndarray, seeds: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the run of ``order`` words at each place, and of its language; the last places have none."""
    return B.mix(B.gram_hashes(words, order) ^ seeds[: max(0, len(words) - order + 1)])


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the bitmap's size is a power of two."""
    at = hashes >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_blocks(order: int, bitmap: Broadcast | None):
    """(lang, gram, mark, f) of the runs of ``order`` words, summed within blocks of pieces."""

    def block(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, names: pa.Array, lang_seeds: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, ends, cuts = B.word_spans(data, offsets, _NOT_BLANK)
        sizes = np.diff(cuts)
        row = np.repeat(np.arange(len(sizes)), sizes)
        words, seeds = B.span_hashes(data, starts, ends), lang_seeds[codes][row]
        for first in range(0, len(words), BLOCK_WORDS):
            last = min(first + BLOCK_WORDS, len(words))
            # a run belongs to the block in which it begins
            own = slice(first, min(last + order - 1, len(words)))
            hashes = marks(words[own], seeds[own], order)
            inside = row[own]
            good = inside[: len(hashes)] == inside[order - 1 :]
            if bitmap is not None:
                parts = is_set(bitmap.value, marks(words[own], seeds[own], order - 1))
                good &= parts[:-1] & parts[1:]
            at = np.flatnonzero(good) + first
            if not len(at):
                continue
            used = np.zeros(len(words), bool)
            for k in range(order):
                used[at + k] = True
            where = np.flatnonzero(used)
            coded = B.spans_to_arrow(data, starts[where], ends[where]).dictionary_encode()
            index = np.full(len(words), -1, np.int32)
            index[where] = coded.indices.to_numpy()
            columns = {"lang": pa.array(codes[row[at]].astype(np.int32))} | {f"w{k}": pa.array(index[at + k]) for k in range(order)}
            keys = ", ".join(columns)
            table = pa.table(columns | {"mark": pa.array(hashes[at - first].view(np.int64)), "m": pa.array(weights[row[at]])})
            for out in duckdb_sums(table, f"SELECT {keys}, min(mark) AS mark, sum(m)::BIGINT AS f FROM rows GROUP BY {keys}"):
                gram = [coded.dictionary.take(out.column(f"w{k}")) for k in range(order)]
                gram = gram[0] if order == 1 else pc.binary_join_element_wise(*gram, " ")
                yield pa.RecordBatch.from_arrays([names.take(out.column("lang")), gram, out.column("mark"), out.column("f")], names=["lang", "gram", "mark", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = B.column_bytes(table["piece"])
            yield from block(data, offsets, *_lang_seeds(table["lang"].combine_chunks()), table["m"].to_numpy())

        for batch in batches:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index("piece")).nbytes
            if size >= 6 * BLOCK_WORDS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _count_bucket(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        reader = pa.RecordBatchReader.from_batches(first.schema, all_batches())
        yield from duckdb_sums(reader, f"SELECT lang, gram, min(mark) AS mark, sum(f)::BIGINT AS f FROM rows GROUP BY lang, gram HAVING sum(f) >= {int(min_count)}")

    return run


def _bitmap(marked: DataFrame, bits: int) -> Broadcast:
    """A broadcast bitmap of 2**bits bits, set at the leading bits of each ``mark``; its size does not grow with the rows."""
    at = F.shiftrightunsigned("mark", 64 - bits)
    part, bit = F.shiftright(at, 15), F.pmod(at, F.lit(1 << 15))
    rows = marked.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for p, b in zip(*(c.to_pylist() for c in rows.toArrow().columns), strict=True):
        out[p * 4096 : p * 4096 + len(b)] = np.frombuffer(b, np.uint8)
    return marked.sparkSession.sparkContext.broadcast(out)


def gram_counts(parts: DataFrame, *, max_words: int, min_count: int, bits: int, buckets: int) -> DataFrame:
    """(lang, gram, n_words, f) of all runs of 1 to ``max_words`` words that occur ``min_count`` times or more in (lang, piece, m)."""
    bitmap, out = None, None
    for order in range(1, max_words + 1):
        grams = parts.mapInArrow(_count_blocks(order, bitmap), "lang string, gram string, mark long, f long")
        # rows of a run: one for each block that holds it, so a frequent run is no hot key
        counted = grams.repartition(buckets, "lang", "gram").mapInArrow(_count_bucket(min_count), "lang string, gram string, mark long, f long")
        counted = materialize(counted, f"runs{order}")
        if bitmap is not None:
            bitmap.unpersist()
        if order < max_words:
            bitmap = _bitmap(counted, bits)
        one = counted.select("lang", "gram", F.lit(order).alias("n_words"), "f")
        out = one if out is None else out.unionAll(one)
    return out


def joined(words: Column, first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def best_cuts(counts: DataFrame, homes: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of runs of two words or more, by the cut with the lowest score.

    Each of ``homes`` groups of candidates asks once for each part that it
    needs, so a part of very many candidates is asked for ``homes`` times at
    most, and the answers go back to the group.
    """
    home = F.pmod(F.xxhash64("lang", "gram"), F.lit(homes)).cast("int")
    asked = counts.where("n_words > 1").select(home.alias("home"), "lang", F.col("gram").alias("phrase"), F.split("gram", " ").alias("words"), F.col("f").alias("a"))
    size = F.size("words")
    cuts = asked.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"first": joined(F.col("words"), 1, F.col("cut")), "rest": joined(F.col("words"), F.col("cut") + 1, size - F.col("cut"))})
    requests = cuts.select("home", "lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    answers = materialize(requests.join(counts.select("lang", F.col("gram").alias("part"), "f"), ["lang", "part"]), "answers")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(answers.select("home", "lang", F.col("part").alias(part), F.col("f").alias(name)), ["home", "lang", part])
    # a to 16 digits: a * a * 1000000 and l * r stay within 38
    a, lo, hi = (F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r"))
    cuts = cuts.withColumn("top", (a * a * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("under", (lo * hi).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("top div under"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return cuts.groupBy("home", "lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def contained(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longest): for each shorter run of two words or more, the count of the most frequent longer one around it."""
    longer = counts.where("n_words > 2").select("lang", F.split("gram", " ").alias("words"), "f")
    spans = longer.select("lang", "words", "f", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    spans = spans.select("lang", "words", "f", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    return spans.select("lang", joined(F.col("words"), F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(
    docs: DataFrame, *, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, bits: int = 27, buckets: int | None = None, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Phrases of two to ``max_words`` words by language: lang, rank, phrase, a, l, r, n, score.

    Texts are split at ``. , ; : ! ?`` and line ends into pieces, A-Z
    lower-cased, and pieces at blanks and tabs into words.  ``a`` counts all
    occurrences of a phrase within pieces (``min_count`` at least), n all words
    of the language.  A cut into two parts with l and r occurrences scores
    floor(1000000 a a / (l r)); the lowest counts, of equal ones the first.
    Phrases inside a longer one that makes up ``share`` per cent of them are
    dropped; the ``top`` phrases of each language are returned, by falling
    score, falling a, and the phrase in byte order.

    A null text counts as empty, a null language as ``und``; empty texts have no
    pieces.  Repeated rows count as often as they occur.  Other columns are
    ignored.  An empty table gives an empty result.

    All counts are exact.  Per task: one block of words, or DuckDB with
    ``DUCKDB_MB`` of memory over one hash bucket.  The bitmaps that spare
    hopeless runs have 2**``bits`` bits whatever the corpus (16 MB).
    """
    parts = materialize(pieces(docs, lang=lang, text=text), "pieces")
    words = F.size(F.split("piece", " "))
    totals = parts.groupBy("lang").agg(F.sum(words * F.col("m")).alias("n"), F.sum(F.octet_length("piece")).alias("bytes"))
    totals = materialize(totals, "totals")
    size = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = buckets or grown(size, 16, BUCKET_BYTES)
    counts = materialize(gram_counts(parts, max_words=max_words, min_count=min_count, bits=bits, buckets=buckets), "counts")
    found = counts.where("n_words > 1").count()
    scored = best_cuts(counts, grown(found, 1024, 100_000)).join(contained(counts), ["lang", "phrase"], "left")
    kept = scored.where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))).select("lang", "phrase", "a", "l", "r", "score")
    # the first of each part, then the first of all parts: both stay near the root of the number of phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(1, math.isqrt(found // top))))
    few = kept.withColumn("part", part)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
