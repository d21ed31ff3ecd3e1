"""Language-model scores by prediction by partial matching over bytes.

Contexts are the last three bytes.  Counts of all four-byte strings of the
training texts form the trie; a symbol unseen in a context escapes to the next
shorter one with probability d / (t + d) (d distinct followers, t occurrences),
and there all followers of the longer context are excluded.  The model is
pretrained.  The distributions of contexts of up to two bytes and of the frequent
contexts of three are worked out once per worker; those of all other contexts
are a table, joined with the positions that need them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import _bytes as B
from brinework.llm._shared import held_out, integer_id, materialize

ORDER = 3
#: Never a byte of UTF-8: stands before and after each text.
EDGE = 255
#: A token holds no blank, so these can't be words.
END_TOKEN = " end"


class PpmModel:
    """log10 probabilities of all bytes in all known contexts, from four-byte counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, base: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """codes: four-byte strings of all contexts, or of some when ``base`` has the counts of all three-byte strings."""
        top = codes.astype(np.int64), counts.astype(np.float64)
        lower = top if base is None else (base[0].astype(np.int64), base[1].astype(np.float64))
        low = np.zeros(256)
        np.add.at(low, lower[0] & 0xFF, lower[1])
        seen = low > 0
        t, d = low.sum(), seen.sum()
        fresh = np.where(~seen, 1 / max(1, 256 - d), 0.0)
        p = np.where(seen, low / max(1, t + d * (d < 256)), (d / (t + d) if t else 1.0) * fresh)
        dists, names, above = [p[None]], np.zeros(1, np.int64), (low[None], fresh[None])
        self.rows = []
        for k in range(1, ORDER + 1):
            bits = 8 * k
            symbols, times = top if k == ORDER else lower
            full, inverse = np.unique(symbols & ((1 << (bits + 8)) - 1), return_inverse=True)
            sums = np.bincount(inverse, times)
            contexts, at = np.unique(full >> 8, return_inverse=True)
            shorter = np.searchsorted(names, contexts & ((1 << (bits - 8)) - 1))
            if k == ORDER:
                #: Names, counts and escape distributions of the two-byte contexts.
                self.above = (names, *above)
            out = np.empty((len(contexts), 256), np.float32)
            kept = [np.empty_like(out), np.empty_like(out)] if k < ORDER else None
            edges = np.searchsorted(at, np.arange(0, len(contexts) + 4096, 4096))
            for i in range(0, len(contexts), 4096):
                n = min(4096, len(contexts) - i)
                a, b = edges[i // 4096], edges[i // 4096 + 1]
                c = np.zeros((n, 256))
                c[at[a:b] - i, full[a:b] & 0xFF] = sums[a:b]
                up = shorter[i : i + n]
                out[i : i + n], q = _distributions(c, above[0][up], above[1][up])
                if kept is not None:
                    kept[0][i : i + n], kept[1][i : i + n] = c, q
            dists.append(out)
            self.rows.append(contexts)
            names, above = contexts, kept
        n3, n2 = len(self.rows[2]), len(self.rows[1])
        self.dense = n3
        self.logp = _log10(np.concatenate([dists[3], dists[2], dists[1], dists[0]])).ravel()
        one = np.full(256, n3 + n2 + len(self.rows[0]), np.int32)
        one[self.rows[0]] = n3 + n2 + np.arange(len(self.rows[0]))
        #: Index of each two-byte context; those unseen share one row of the last byte.
        self.two = (n2 + (np.arange(65536) & 0xFF)).astype(np.int32)
        self.two[self.rows[1]] = np.arange(n2)
        self.three = np.empty((n2 + 256, 256), np.int32)
        self.three[:n2] = (n3 + np.arange(n2))[:, None]
        self.three[n2:] = one[:, None]
        c = self.rows[2]
        self.three[self.two[c & 0xFFFF], c >> 16] = np.arange(n3)
        self.three = self.three.ravel()

    def context_logs(self, contexts: np.ndarray, owner: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probabilities of all bytes in three-byte ``contexts``; ``owner`` tells whose follower a symbol is."""
        names, up_counts, escaped = self.above
        c = np.zeros((len(contexts), 256))
        c[owner, symbols] = counts
        up = np.searchsorted(names, contexts & 0xFFFF)
        return _log10(_distributions(c, up_counts[up], escaped[up])[0].astype(np.float32))

    def row_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each row's bytes and its end."""
        return self.split_scores(data, offsets, False)[0]

    def split_scores(self, data: np.ndarray, offsets: np.ndarray, apart: bool) -> tuple[np.ndarray, ...]:
        """:meth:`row_scores`, as the first of a tuple.

        With ``apart`` positions in three-byte contexts that this model does
        not hold are left out of the sums and come beside them, once for each
        row and code: row, code, times, log10 probability by the shorter context.
        """
        padded, starts = _padded(data, offsets)
        a, b, c = padded[:-3].astype(np.int32), padded[1:-2].astype(np.int32), padded[2:-1].astype(np.int32)
        rows = self.three[(self.two[(b << 8) | c].astype(np.int64) << 8) | a].astype(np.int64)
        got = self.logp[(rows << 8) | padded[3:]].astype(np.float64)
        # position i scores byte i + 3; a row's bytes and end begin at its start
        begin, stop = starts[:-1], starts[1:] - 3
        other = ()
        if apart:
            at = np.flatnonzero(rows >= self.dense)
            of = np.searchsorted(starts, at, "right") - 1
            at, of = at[at < stop[of]], of[at < stop[of]]
            x = padded.astype(np.int64)
            codes = (x[at] << 24) | (x[at + 1] << 16) | (x[at + 2] << 8) | x[at + 3]
            _, first, times = np.unique((of << 32) | codes, return_index=True, return_counts=True)
            other = (of[first], codes[first], times, got[at[first]])
            got[at] = 0
        total = np.concatenate([[0.0], np.cumsum(got)])
        return (total[stop] - total[begin], *other)


def _distributions(c: np.ndarray, counts_up: np.ndarray, escaped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all bytes, and of those without a count after an escape, from counts (contexts, 256).

    counts_up, escaped: counts and escape distribution of each context without its first byte.
    """
    have = c > 0
    t, d = c.sum(1, keepdims=True), have.sum(1, keepdims=True)
    rest = np.where(have, 0, counts_up)
    t2, d2 = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
    after = np.where(rest > 0, 0, np.where(have, 0, escaped))
    left = after.sum(1, keepdims=True)
    total = t2 + d2 * (left > 0)
    spread = np.where(left > 0, after / np.maximum(left, 1e-300), 0)
    q = np.where(total > 0, (rest + np.where(left > 0, d2, 0) * spread) / np.maximum(total, 1e-300), spread)
    some = q.sum(1, keepdims=True) > 0
    return np.where(have, c, d * q) / (t + d * some), q


def _log10(p: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(p, 1e-30)).astype(np.float32)


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with three edges before and one after each, and where each begins."""
    sizes = np.diff(offsets)
    starts = offsets + 4 * np.arange(len(offsets))
    out = np.full(starts[-1] if len(sizes) else 0, EDGE, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts[:-1] + 3 - offsets[:-1], sizes)] = data
    return out, starts


def count_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct four-byte codes of the padded rows and their counts."""
    x, starts = _padded(data, offsets)
    if len(x) < 4:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    x = x.astype(np.uint32)
    codes = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    inside = np.ones(len(codes), bool)
    for j in (1, 2, 3):
        inside[starts[1:-1] - j] = False
    return _count(codes[inside])


def _count(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[new], np.diff(np.concatenate([new, [len(values)]]))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


def _read(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = B.column_bytes(batch.column(batch.schema.get_field_index(text)))
    return B.LOWER[data], offsets


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of four-byte codes: (word, hash, n), a code has no word."""
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        data, offsets = _read(batch, "text")
        for first, last in B.blocks(offsets, 1 << 24):
            part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            seen = []
            for a, b in B.blocks(at):
                piece, rows = part[at[a] : at[b]], at[a : b + 1] - at[a]
                starts, ends, _ = B.word_spans(piece, rows)
                h = B.span_hashes(piece, starts, ends)
                order = np.argsort(h)
                h = h[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                seen.append((h[new], starts[order[new]] + at[a], ends[order[new]] + at[a], np.diff(np.concatenate([new, [len(h)]])) if len(h) else np.empty(0, np.int64)))
                grams.append(count_grams(piece, rows))
            if len(grams) > 16:
                grams = [_merge(grams)]
            h, starts, ends, n = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.argsort(h, kind="stable")
            h, starts, ends, n = h[order], starts[order], ends[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            if len(new):
                yield pa.RecordBatch.from_arrays([B.spans_to_arrow(part, starts[new], ends[new]), pa.array(h[new].view(np.int64)), pa.array(np.add.reduceat(n, new))], names=["word", "hash", "n"])
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([END_TOKEN]), pa.array([0]), pa.array([batch.num_rows])], names=["word", "hash", "n"])
    if grams:
        codes, counts = _merge(grams)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "hash", "n"])


def lm_scores(docs: DataFrame, *, modulus: int = 7, remainder: int = 2, frequent_words: int = 100_000, frequent_contexts: int = 100_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every whole text under models of all texts that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-
    one unigram model over blank-parted words and one end), score (log10
    probability of the lower-cased bytes and an end under the PPM model), and
    bytes.  Null texts count as empty: one end token.  With no training text
    every byte is equally likely.  Each row is scored on its own, repeated rows
    too; null ids are learned from.  Ids are integers.

    Word counts are shuffled by word.  Counts of the at most ``frequent_words``
    most frequent words are broadcast and applied in place; all other words of
    a document are joined with their counts by a shuffle on the word.  The trie
    is treated alike: counts of three-byte strings (at most 2**24, whatever the
    corpus) and of the followers of the at most ``frequent_contexts`` most
    frequent contexts are broadcast; each other context is a row of 256 log
    probabilities, joined in the same shuffle.  No string is dropped, and the
    bounds don't change a result.
    """
    spark = docs.sparkSession
    rows = docs.select(integer_id(docs, doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = F.xxhash64("doc_id", "text")
    part = materialize(rows.where(~held_out("doc_id", modulus, remainder)).select("text").mapInArrow(_train, "word string, hash long, n long"), "counts")
    words = materialize(part.where(F.col("word").isNotNull()).groupBy("word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n")), "words")
    totals = words.agg(F.sum("n"), F.count("*")).first()
    n_train, vocabulary = totals[0] or 0, totals[1]
    least = _frequent(words, "n", frequent_words)
    often = words.where((F.col("n") >= least) & (F.col("word") != END_TOKEN)).select("hash", "n").toArrow()
    ends = words.where(F.col("word") == END_TOKEN).select("n").first()
    codes = part.where(F.col("word").isNull()).groupBy("hash").agg(F.sum("n").alias("n"))
    codes = materialize(codes.withColumn("context", F.shiftright("hash", 8)), "codes")
    contexts = materialize(codes.groupBy("context").agg(F.sum("n").alias("context_n")), "contexts")
    least_context = _frequent(contexts, "context_n", frequent_contexts)
    common = contexts.where(F.col("context_n") >= least_context)
    apart = contexts.count() > common.count()
    shorter = codes.groupBy(F.col("hash").bitwiseAND(F.lit(0xFFFFFF)).alias("hash")).agg(F.sum("n").alias("n")).toArrow()
    dense = codes.join(F.broadcast(common), "context", "left_semi").select("hash", "n").toArrow()
    order = np.argsort(often.column("hash").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(
        {
            "hash": often.column("hash").to_numpy().view(np.uint64)[order],
            "n": often.column("n").to_numpy()[order].astype(np.int64),
            "end": ends[0] if ends else 0,
            "codes": (dense.column("hash").to_numpy(), dense.column("n").to_numpy()),
            "shorter": (shorter.column("hash").to_numpy(), shorter.column("n").to_numpy()),
            "scale": n_train + vocabulary + 1,
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if "ppm" not in m:  # the worker keeps it for its next task
            m["ppm"] = PpmModel(*m["codes"], m["shorter"])
        ppm = m["ppm"]
        logs = np.log10((m["n"] + 1) / m["scale"])
        end = np.log10((m["end"] + 1) / m["scale"])
        for batch in batches:
            data, offsets = _read(batch, "text")
            ids = batch.column(batch.schema.get_field_index("doc"))
            for a, b in B.blocks(offsets):
                piece, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                n = b - a
                starts, ends, spans = B.word_spans(piece, at)
                h = B.span_hashes(piece, starts, ends)
                count = np.diff(spans)
                of = np.repeat(np.arange(n), count)
                where = np.searchsorted(m["hash"], h)
                known = np.zeros(len(h), bool)
                if len(m["hash"]):
                    where = np.minimum(where, len(m["hash"]) - 1)
                    known = m["hash"][where] == h
                base = np.bincount(of[known], logs[where[known]], n) + end
                score, *other = ppm.split_scores(piece, at, apart)
                yield _scored(ids.slice(a, n), None, count + 1, np.bincount(of[known], minlength=n) + (m["end"] > 0), base, score, np.diff(at))
                rare = np.flatnonzero(~known)
                if len(rare):
                    key = B.mix(h[rare] ^ (of[rare].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    _, first, times = np.unique(key, return_index=True, return_counts=True)
                    rare = rare[first]
                    yield _scored(ids.take(pa.array(of[rare] + a)), B.spans_to_arrow(piece, starts[rare], ends[rare]), times)
                if apart and len(other[0]):
                    yield _scored(ids.take(pa.array(other[0] + a)), pa.array([f" #{x}" for x in (other[1] >> 8).tolist()]), other[2], symbol=other[1] & 0xFF, shorter=other[3])

    schema = "doc struct<id:long,row:long>, word string, times long, known long, base double, score double, bytes long, symbol int, shorter double"
    doc = F.struct(F.col("doc_id").cast("long").alias("id"), row.alias("row"))
    scored = rows.select(doc.alias("doc"), "text").mapInArrow(run, schema)
    # a row for the document itself has a key that no word equals, and no count
    key = F.coalesce(F.col("word"), F.concat_ws(" ", F.lit(""), F.col("doc.id").cast("string"), F.col("doc.row").cast("string")))
    less = words.where((F.col("n") < least) & (F.col("word") != END_TOKEN)).select(F.col("word").alias("key"), F.col("n").alias("c"), F.lit(None).cast("array<float>").alias("logs"))
    if apart:  # blanks keep the names of contexts apart from words
        followers = codes.join(contexts.where(F.col("context_n") < least_context), "context", "left_semi").groupBy("context")
        lists = followers.agg(F.collect_list(F.struct((F.col("hash") % 256).alias("symbol"), "n")).alias("followers"))
        logs = lists.mapInArrow(_context_rows(shared), "context long, logs array<float>")
        less = less.unionAll(logs.select(F.concat(F.lit(" #"), F.col("context").cast("string")), F.lit(None).cast("long"), "logs"))
    joined = scored.withColumn("key", key).join(less, "key", "left")
    whole, code = F.col("word").isNull(), F.col("symbol").isNotNull()
    unit = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 1) / F.lit(float(n_train + vocabulary + 1)))
    out = joined.groupBy("doc").agg(
        F.count(F.when(whole, 1)).alias("copies"),
        F.max(F.when(whole, F.col("times"))).alias("n_tokens"),
        (F.max(F.when(whole, F.col("known")))).alias("often"),
        F.sum(F.when(~whole & ~code & F.col("c").isNotNull(), F.col("times"))).alias("rare"),
        F.max(F.when(whole, F.col("base"))).alias("base"),
        F.sum(F.when(~whole & ~code, F.col("times") * unit)).alias("rare_base"),
        F.sum(F.when(code, F.col("times") * F.coalesce(F.get("logs", F.col("symbol")).cast("double"), F.col("shorter")))).alias("rare_score"),
        F.max("score").alias("score"),
        F.max("bytes").alias("bytes"),
    )
    # rows that repeat an id and its text are counted together and given back one by one
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.col("doc.id").alias("doc_id"),
        held_out(F.col("doc.id"), modulus, remainder).alias("held_out"),
        "n_tokens",
        (F.col("often") + F.coalesce("rare", F.lit(0)) / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) / F.col("copies")).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0)) / F.col("copies")).alias("score"),
        "bytes",
    )


def _frequent(counts: DataFrame, n: str, room: int) -> int:
    """The count from which at most ``room`` rows are frequent; rows of about one count go together."""
    levels = counts.groupBy(F.floor(F.log2(n) * 4).alias("level")).agg(F.count("*").alias("k"), F.min(n).alias("least")).collect()
    least = 2**62
    for level in sorted(levels, key=lambda r: -r.level):
        room -= level.k
        if room < 0:
            break
        least = level.least
    return least


def _context_rows(shared):
    """(context, followers) rows to their log10 probabilities; a context has at most 256 followers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if "shorter_ppm" not in m:
            m["shorter_ppm"] = PpmModel(np.empty(0, np.int64), np.empty(0, np.int64), m["shorter"])
        for batch in batches:
            contexts, lists = batch.column(0).to_numpy(), batch.column(1)
            owner = np.repeat(np.arange(len(contexts)), np.diff(lists.offsets.to_numpy()))
            seen = lists.flatten()
            logs = m["shorter_ppm"].context_logs(contexts, owner, seen.field("symbol").to_numpy(), seen.field("n").to_numpy())
            cuts = pa.array(np.arange(0, 256 * len(contexts) + 1, 256, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(logs.ravel()))], names=["context", "logs"])

    return run


def _scored(ids, words, times, known=None, base=None, score=None, size=None, symbol=None, shorter=None) -> pa.RecordBatch:
    n = len(times)
    arrays = [ids, pa.nulls(n, pa.string()) if words is None else words, pa.array(np.asarray(times, np.int64))]
    for values, kind in ((known, pa.int64()), (base, pa.float64()), (score, pa.float64()), (size, pa.int64()), (symbol, pa.int32()), (shorter, pa.float64())):
        arrays.append(pa.nulls(n, kind) if values is None else pa.array(np.asarray(values), kind))
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "word", "times", "known", "base", "score", "bytes", "symbol", "shorter"])
