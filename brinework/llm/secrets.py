"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers.

Only DataFrame functions are used.  Positions come from the pieces between the
matches: ``split`` and ``regexp_extract_all`` see the same leftmost matches, so
the running sum of piece and match lengths gives each start in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.llm._shared import PREFIX, materialize

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Key characters a run must have at least to be judged by the Markov models.
LEAST = 12
_BASE = "|".join((ASSIGN.replace("([A-Za-z0-9", "(?:[A-Za-z0-9"), ACCESS, HEX))
#: What the fixed patterns match, or a run of key characters in which none of them begins.
_KEY = "[A-Za-z0-9+/_=-]"
# a run begins where no key character stands before it, or where a match has just ended
TOKEN = rf"{_BASE}|(?:(?<!{_KEY})|\G)(?={_KEY}{{{LEAST}}})(?:(?!{_BASE}){_KEY}){{{LEAST},}}"
#: The same where no fixed pattern matches.
RUN = rf"{_KEY}{{{LEAST},}}"
#: Stretches of a run between the characters that part names and paths.
PART = rf"[A-Za-z0-9+]{{{LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET) + 1  # the last state is the edge of a string


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start, end>> of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.array().cast("array<struct<m:string,start:long,end:long>>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        stop = begin + F.length(x["m"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), begin.cast("long").alias("start"), stop.cast("long").alias("end")))).alias("out"), stop.cast("long").alias("at"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<m:string,start:long,end:long>>"))


def _states(word: Column) -> Column:
    """The string's characters as numbers, with an edge before and after."""
    inner = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(ALPHABET)), F.lit(0)), F.lit(_N)) - 1)
    edge = F.array(F.lit(_N - 1))
    return F.concat(edge, inner, edge)


def default_samples(spark: SparkSession, docs: DataFrame, *, text: str = "text", per_class: int = 20_000, words_each: int = 20) -> DataFrame:
    """Labelled samples (text, random): generated keys against words of the corpus.

    Random strings are base64, alphanumeric and hexadecimal renderings of SHA-2
    digests of 1..per_class.  Ordinary identifiers are words of the documents,
    alone and joined in pairs by ``_ - / =``, by a number or by a capital; at most
    ``per_class`` documents, in order of a hash of their words, give ``words_each`` words each.
    Both bounds hold for fitting only.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    random = spark.range(per_class).select(F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, F.translate(base64, "+/=", "")).otherwise(digest).alias("text"), F.lit(True).alias("random"))
    # a cut by the texts' hash first, so neither the words of all texts nor one large sort are needed
    share = max(1, docs.count() // (2 * max(1, per_class)))
    some = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(share)) == 0)
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ASSIGN + "|" + ACCESS + "|" + HEX, " ")
    words = some.select(F.slice(F.regexp_extract_all(plain, F.lit(r"[A-Za-z]{2,}"), F.lit(0)), 1, words_each).alias("w")).where(F.size("w") > 1).distinct()
    words = words.orderBy(F.xxhash64(F.concat_ws(" ", "w")), "w").limit(per_class)
    # words joined as names and paths join them, and words with a number behind
    k = lambda a: F.length(a) % 6
    joint = lambda a: F.when(k(a) == 0, "_").when(k(a) == 1, "-").when(k(a) == 2, "/").when(k(a) == 3, "=").when(k(a) == 4, F.length(a).cast("string")).otherwise("")
    pair = F.zip_with(F.col("w"), F.concat(F.slice("w", 2, words_each - 1), F.array(F.lit("id"))), lambda a, b: F.concat(a, joint(a), F.when(k(a) == 5, F.initcap(b)).otherwise(b)))
    ordinary = words.select(F.explode(F.concat("w", pair)).alias("text"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def train(samples: DataFrame, *, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all character pairs, random against ordinary.

    samples: (text, random); null rows are left out.  Both classes are first-
    order Markov chains with ``smoothing`` added to each transition.  At most
    2 * 69 * 69 counts reach the driver.
    """
    states = samples.where(F.col("text").isNotNull() & F.col("random").isNotNull()).select("random", _states(F.col("text")).alias("s"))
    pairs = states.select("random", F.explode(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: a * _N + b)).alias("pair"))
    counts = {True: [smoothing] * (_N * _N), False: [smoothing] * (_N * _N)}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] += row["count"]
    sums = {k: [sum(v[a * _N : (a + 1) * _N]) for a in range(_N)] for k, v in counts.items()}
    return [math.log(counts[True][i] / sums[True][i // _N]) - math.log(counts[False][i] / sums[False][i // _N]) for i in range(_N * _N)]


def log_ratio(word: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string under the two chains; above 0 the random one is likelier."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(_N - 1).alias("last"), F.lit(0.0).alias("sum"))
    moved = F.aggregate(_states(word), start, lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.get(table, acc["last"] * _N + s)).alias("sum")), lambda acc: acc["sum"])
    return moved - F.get(table, F.lit((_N - 1) * _N + _N - 1))


def scan(docs: DataFrame, model: list[float], *, threshold: float = 12.0, text: str = "text", spans_col: str = "secrets") -> DataFrame:
    """``docs`` with array<struct<kind, start, end>> of all secrets in each whole text.

    Fixed patterns come first: ``assign`` (a named value of 6 or more
    characters), ``access`` and ``hex`` keys, each leftmost and non-overlapping
    within its kind.  Runs of ``LEAST`` or more key characters beside and between
    the fixed spans are judged by the Markov models: a run whose log-likelihood
    ratio is at least ``threshold`` is added as ``markov``, else those of its
    stretches between ``/ = _ -`` that reach it; runs without a letter are numbers.  Start and end count code
    points, the end is exclusive; spans are sorted by start, then kind.  Null
    and empty texts have no spans; repeated rows have the same spans each; an
    empty table gives an empty result.  Other columns stay; one that bears the
    new name is replaced.
    """
    docs = docs.drop(spans_col)
    body, base, named = PREFIX + "body", PREFIX + "base", PREFIX + "named"
    value = F.coalesce(F.col(text), F.lit(""))

    def kind(name: str, col: Column) -> Column:
        return F.transform(col, lambda x: F.struct(F.lit(KINDS.index(name)).alias("k"), x["start"].alias("start"), x["end"].alias("end")))

    assign = F.filter(F.col(named), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6)
    fixed = F.concat(kind("assign", assign), kind("access", matches(F.col(body), ACCESS)), kind("hex", matches(F.col(body), HEX)))
    out = docs.withColumn(body, value).withColumn(named, matches(F.col(body), ASSIGN)).withColumn(base, fixed)
    beside = F.filter(matches(F.col(body), TOKEN), lambda x: ~x["m"].rlike(f"^(?:{_BASE})"))
    # a text without fixed spans, as most are, has its runs by a plainer pattern
    runs = F.when((F.size(F.col(base)) > 0) | (F.size(F.col(named)) > 0), beside).otherwise(matches(F.col(body), RUN))

    def random(m: Column) -> Column:
        return m.rlike("[A-Za-z]") & (log_ratio(m, model) >= threshold)

    def judged(run: Column) -> Column:
        parts = F.transform(matches(run["m"], PART), lambda p: F.struct(p["m"].alias("m"), (run["start"] + p["start"]).alias("start"), (run["start"] + p["end"]).alias("end")))
        inside = F.when(run["m"].rlike("[/=_-]"), F.filter(parts, lambda p: random(p["m"])))
        return F.when(random(run["m"]), F.array(run)).otherwise(F.coalesce(inside, F.array().cast("array<struct<m:string,start:bigint,end:bigint>>")))

    more = F.flatten(F.transform(runs, judged))
    merged = F.sort_array(F.transform(F.concat(base, kind("markov", more)), lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return out.withColumn(spans_col, F.transform(merged, lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).drop(body, base, named)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def fit(docs: DataFrame, *, text: str = "text", per_class: int = 20_000) -> list[float]:
    return train(materialize(default_samples(docs.sparkSession, docs, text=text, per_class=per_class), "secret-samples"))
