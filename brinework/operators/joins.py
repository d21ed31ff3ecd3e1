"""Name matching and containment joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.text import name_text, without_blanks

#: Listed names and the names under which they file.
LISTED_NAMES = {
    "현대차": "현대자동차",
    "한국전력": "한국전력공사",
    "KT&G": "케이티앤지",
    "LS ELECTRIC": "LS일렉트릭",
    "삼성화재": "삼성화재해상보험",
    "KT": "케이티",
    "NAVER": "네이버",
}


def match_names(names: DataFrame, companies: DataFrame, *, name: str = "name", company: str = "corp_name", code: str = "corp_code", aliases: Mapping[str, str] = LISTED_NAMES) -> DataFrame:
    """Each name with the code of the company it means, and the step that found it.

    Tried in order: 1 the name itself, 2 its alias, 3 without blanks, 4 without
    the preferred-share suffix 우, 5 the alias without blanks.  All candidate
    keys become rows and join by equality; the lowest step wins, then the
    smallest code.  Names without a match come back with null code.
    """
    key = name_text(F.col(name))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    alias = F.try_element_at(table, key)
    base = F.when(key.endswith("우"), F.expr("substring(_key, 1, length(_key) - 1)"))
    options = [(1, key, False), (2, alias, False), (3, without_blanks(key), True), (4, base, False), (4, without_blanks(base), True), (5, without_blanks(alias), True)]
    candidates = names.withColumn("_key", key).select(F.col(name).alias("name"), F.explode(F.array(*[F.struct(F.lit(s).alias("step"), k.alias("key"), F.lit(b).alias("bare")) for s, k, b in options])).alias("c")).select("name", "c.*").where("key is not null")
    full = name_text(F.col(company))
    keys = companies.select(F.col(code).alias("code"), F.explode(F.array(F.struct(full.alias("key"), F.lit(False).alias("bare")), F.struct(without_blanks(full).alias("key"), F.lit(True).alias("bare")))).alias("k")).select("code", "k.*").distinct()
    found = candidates.join(keys, ["key", "bare"]).groupBy("name").agg(F.min(F.struct("step", "code")).alias("m"))
    return names.select(F.col(name).alias("name")).distinct().join(found, "name", "left").select("name", F.col("m.code").alias("code"), F.col("m.step").alias("step"))


_NO_WORD = r"[^\p{L}\p{N}]+"


def contained_terms(texts: DataFrame, terms: DataFrame, *, key: str, text: str, term: str, broadcast_words: int = 500_000) -> DataFrame:
    """Pairs of a text (by its unique ``key``) and a term that it contains, case folded; blank terms match nothing.

    A word inside a term stands whole in every text that holds the term, so
    terms meet texts by the one of these words that fewest texts have.  Terms
    of one or two words meet the distinct words of the texts that hold their
    longest word, by its first two characters; terms without a word meet texts
    by their first character.  All pairs are then looked up in full.
    """
    low = F.split(F.lower(F.col(term)), _NO_WORD)
    filled = lambda c: F.filter(c, lambda w: w != "")
    inner = filled(F.when(F.size(low) > 2, F.slice(low, F.lit(2), F.greatest(F.size(low) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    longest = F.array_max(F.transform(filled(low), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    marked = terms.where(F.col(term) != "").withColumns({"_inner": inner, "_piece": longest})
    plain = [F.col(c) for c in terms.columns]
    body = texts.select(key, F.lower(F.col(text)).alias("_text"))
    words = body.select(key, F.explode(F.array_distinct(filled(F.split("_text", _NO_WORD)))).alias("_word"))

    inside = marked.where(F.size("_inner") > 0).select(*plain, F.explode(F.array_distinct("_inner")).alias("_word"))
    wanted = inside.select("_word").distinct()
    small = wanted.count() <= broadcast_words
    postings = words.join(F.broadcast(wanted) if small else wanted, "_word", "left_semi")
    often = postings.groupBy("_word").agg(F.count("*").alias("_df"))
    # a word that no text has rules its term out
    rarest = inside.join(often, "_word", "left").groupBy(*plain).agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_word"))["_word"].alias("_word"))
    candidates = postings.join(rarest, "_word").drop("_word")

    short = marked.where((F.size("_inner") == 0) & F.col("_piece").isNotNull())
    if not short.isEmpty():
        pieces = short.select(*plain, "_piece", F.substring("_piece", 1, 2).alias("_gram"))
        places = F.sequence(F.lit(1), F.length("_word"))
        grams = F.array_distinct(F.concat(F.transform(places, lambda i: F.substring(F.col("_word"), i, F.lit(1))), F.transform(places, lambda i: F.substring(F.col("_word"), i, F.lit(2)))))
        vocabulary = words.select("_word").distinct().withColumn("_gram", F.explode(grams))
        held = vocabulary.join(pieces, "_gram").where(F.contains("_word", "_piece")).select("_word", *plain)
        candidates = candidates.unionByName(words.join(held, "_word").drop("_word").distinct())
    marks = marked.where(F.col("_piece").isNull())
    if not marks.isEmpty():
        signs = body.select(key, F.explode(F.array_distinct(F.split(F.regexp_replace("_text", r"[\p{L}\p{N}]+", ""), ""))).alias("_sign"))
        candidates = candidates.unionByName(signs.join(marks.select(*plain, F.substring(term, 1, 1).alias("_sign")), "_sign").drop("_sign"))
    return texts.join(candidates, key).where(F.contains(F.lower(F.col(text)), F.lower(F.col(term))))


def question_companies(questions: DataFrame, companies: DataFrame, *, question: str = "question", alias: str = "alias", ticker: str = "ticker") -> DataFrame:
    """Pairs of a question and a company, named by an alias (blanks ignored) or a six-digit ticker.

    The company table is a dimension with one row per alias; of several
    aliases of one company the longest that fits counts.  Aliases are matched
    by their first two characters (or the only one) against those of the question, then in full.
    """
    bare = F.lower(F.regexp_replace(F.col(question), r"\s+", ""))
    short = F.lower(F.regexp_replace(F.col(alias), r"\s+", ""))
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(2)))
    grams = F.array_distinct(F.concat(two, F.split(bare, "")))
    q = questions.select("*", bare.alias("_bare"), F.explode(grams).alias("_gram"))
    names = companies.select("*", short.alias("_short"), F.substring(short, 1, 2).alias("_gram"))
    by_name = q.join(names, "_gram").where(F.contains("_bare", "_short")).drop("_gram", "_bare", "_short")
    codes = questions.withColumn(ticker, F.explode(F.array_distinct(F.regexp_extract_all(F.col(question), F.lit(r"(?<!\d)(\d{6})(?!\d)"), F.lit(1)))))
    by_code = codes.join(companies, ticker)
    both = by_name.unionByName(by_code.select(by_name.columns))
    order = Window.partitionBy(question, ticker).orderBy(F.desc(F.length(alias)), alias)
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def prefix_or_title(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Each report (report_id, day yyyymmdd, title) with a file (path, name, body).

    A file whose name starts with the day is taken, one whose body holds the
    title first, then by path; failing that, the first file whose body holds
    the title's first 20 characters.

    Files become one row per day, and one per body of a day, before reports
    join them.  Titles meet the bodies of their day by the longest word inside
    the title, which a body that holds the title holds as a whole word; titles
    of one or two words by their first two characters (or the only one).  A hash
    of the body goes along with its words and characters, which are looked up by
    the titles of the day; bodies join the few pairs that are left.
    """
    words = _NO_WORD
    dated = files.select(F.substring("name", 1, 8).alias("day"), "path", "body")
    days = dated.groupBy("day").agg(F.min("path").alias("_any"), F.min(F.struct(F.col("body").isNull().alias("n"), "path")).alias("_first"))
    parts = F.split("title", words)
    inner = F.array_max(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    titles = reports.where("title <> ''").select("day", "title").distinct().withColumn("_word", F.when(F.size(parts) > 2, F.nullif(inner, F.lit(""))))
    titles = titles.withColumn("_gram", F.when(F.col("_word").isNull(), F.substring("title", 1, 2)))
    bodies = dated.where("body is not null").groupBy("day", "body").agg(F.min("path").alias("_held")).withColumn("_body", F.xxhash64("body"))
    by_word = bodies.select("day", "_body", F.explode(F.array_distinct(F.split("body", words))).alias("_word"))
    # only days with titles that have no inner word need the characters of their bodies
    short = titles.where("_gram is not null").select("day").distinct()
    signs = bodies.join(short, "day").select("day", "_body", F.split("body", "").alias("_signs"))
    pairs = F.zip_with("_signs", F.slice("_signs", F.lit(2), F.size("_signs")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    by_gram = signs.select("day", "_body", F.explode(F.array_distinct(F.concat("_signs", pairs))).alias("_gram"))
    near = by_word.join(titles.where("_word is not null"), ["day", "_word"]).select("day", "_body", "title")
    near = near.unionByName(by_gram.join(titles.where("_gram is not null"), ["day", "_gram"]).select("day", "_body", "title"))
    held = near.join(bodies, ["day", "_body"]).where(F.contains("body", "title")).groupBy("day", "title").agg(F.min("_held").alias("_held"))
    path = F.coalesce("_held", F.when(F.col("title").isNull(), F.col("_any")).otherwise(F.col("_first.path")))
    by_day = reports.join(days, "day").join(held, ["day", "title"], "left").groupBy("report_id").agg(F.min(F.struct(F.col("_held").isNull().alias("n"), path.alias("path")))["path"].alias("path")).withColumn("matched_by", F.lit("day"))
    rest = reports.join(by_day, "report_id", "left_anti").withColumn("stub", F.substring("title", 1, 20)).where("length(stub) > 0")
    found = contained_terms(files, rest.select("report_id", "stub"), key="path", text="body", term="stub")
    by_title = found.groupBy("report_id").agg(F.min("path").alias("path")).withColumn("matched_by", F.lit("title"))
    return reports.join(by_day.unionByName(by_title), "report_id", "left")
