"""Dedupe, upsert, latest rows, name matching, sequences, sessions and increments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.functions.dates import temporal, temporal_filter
from brinework.operators import chat, dedupe, joins, quiz, sequences
from brinework.operators.bucketed import BucketedTable
from brinework.queries import query, table
from brinework.session import working_folder
from brinework.sources import observed, variants
from brinework.streaming import increments


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return dedupe.pending(docs, table(spark, sf_dir, "embeddings"), "doc_id", "vec_id")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id, event_type")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the events merged, the later row of each key stays."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return dedupe.upsert(dedupe.keep_latest(old, ["user_id", "event_type"], ["ts", "event_id"]), new, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT min(doc_id) AS doc_id, length(text) AS n FROM documents GROUP BY text")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, by partial aggregates."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_first_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("WITH old AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), inc AS (SELECT o_orderkey, -o_totalprice AS o_totalprice FROM orders) SELECT * FROM old UNION ALL SELECT * FROM inc WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows whose key exists do nothing."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return dedupe.insert_new(orders.where("o_orderkey % 2 = 0"), orders.withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderkey"], ["o_totalprice"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.delete_keys(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def listed_only_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.only_listed(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("documents", "embeddings", "labels", "pages"):
        part = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_groups_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def grouping_sets_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall and per-group means in one pass."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.rollup("lang").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count("*").alias("n"))


@query("SELECT lang, round(avg(length(text) // 4), 6) AS avg_tokens, min(length(text) // 4) AS min_tokens, max(length(text) // 4) AS max_tokens FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.length("text") / 4)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(n), 6).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"))


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_extract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).where("k > 50")


@query("SELECT c_custkey, n_name, 'nation' AS matched FROM customer JOIN nation ON n_nationkey = c_nationkey")
def name_match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with blanks and a suffix find their company by falling back step by step."""
    nation = table(spark, sf_dir, "nation")
    cust = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    spaced = F.when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit("우"))).otherwise(F.regexp_replace("n_name", r"(.)(.)", "$1 $2"))
    names = cust.select("c_custkey", "n_name", spaced.alias("name"))
    found = joins.match_names(names.select("name").distinct(), nation.select(F.col("n_name").alias("corp_name"), F.col("n_nationkey").cast("string").alias("corp_code")))
    codes = nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("company"))
    out = names.join(found, "name").join(F.broadcast(codes), "code").where("company = n_name")
    return out.select("c_custkey", F.col("company").alias("n_name"), F.lit("nation").alias("matched"))


@query("SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text))")
def alias_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item verbatim, found by an equality join on words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("term"))
    return joins.contained_terms(docs, items, key="doc_id", text="body", term="term").select("doc_id", "item_id").distinct()


@query(
    "WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, o_orderpriority AS title, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path FROM orders), f AS (SELECT day, min(path) AS first_path FROM o GROUP BY day), "
    "b AS (SELECT day, title AS body, min(path) AS path FROM o GROUP BY 1, 2), t AS (SELECT day, title, min(b.path) AS held_path FROM (SELECT DISTINCT day, title FROM o) JOIN b USING (day) WHERE contains(body, title) GROUP BY 1, 2) "
    "SELECT o_orderkey AS report_id, coalesce(held_path, first_path) AS path, CASE WHEN first_path IS NOT NULL THEN 'day' END AS matched_by FROM o LEFT JOIN f USING (day) LEFT JOIN t USING (day, title)"
)
def prefix_or_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as reports and as files, each report with the file of its day and, if there is one, of its priority."""
    orders = table(spark, sf_dir, "orders")
    day, path = F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    reports = orders.select(F.col("o_orderkey").alias("report_id"), day.alias("day"), F.col("o_orderpriority").alias("title"))
    files = orders.select(path.alias("path"), F.concat(day, F.lit("_"), path).alias("name"), F.col("o_orderpriority").alias("body"))
    return joins.prefix_or_title(reports, files).select("report_id", "path", "matched_by")


@query(
    "SELECT item_id AS report_id, min(lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path, CASE WHEN count(doc_id) > 0 THEN 'title' END AS matched_by "
    "FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 1, 20))) GROUP BY item_id"
)
def title_match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as reports without a file of their day, each with the first document that holds the start of its text."""
    reports = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("report_id"), F.lit("none").alias("day"), F.col("text").alias("title"))
    path = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    files = table(spark, sf_dir, "documents").select(path.alias("path"), path.alias("name"), F.col("text").alias("body"))
    return joins.prefix_or_title(reports, files).select("report_id", "path", "matched_by")


@query("SELECT conv_id, turn, lag(text) OVER w AS prev_context, lead(text) OVER w AS next_context FROM (SELECT conv_id, turn, CASE WHEN len(string_split(text, ' ')) > 100 THEN array_to_string(string_split(text, ' ')[1:100], ' ') || '...' ELSE text END AS text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_window_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.neighbours(table(spark, sf_dir, "conversations"), partition=["conv_id"], order=["turn"]).select("conv_id", "turn", "prev_context", "next_context")


@query("SELECT conv_id, turn, conv_id || '_' || role || '_chat_' || printf('%03d', row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) AS chunk_id FROM conversations")
def running_ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("doc", F.col("conv_id").cast("string")).withColumn("section", F.lit("log > chat"))
    return sequences.ordinal_ids(rows, document="doc", kind="role", section="section", order=["turn"]).select("conv_id", "turn", "chunk_id")


@query(
    "WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT *, CASE WHEN contains(line, '|') THEN 1 ELSE 0 END AS t FROM l), "
    "n AS (SELECT *, CASE WHEN t IS DISTINCT FROM lag(t) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS b FROM m), i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM n) "
    "SELECT doc_id, CAST(island AS BIGINT) AS island, max(t) = 1 AS is_table, count(*) AS n_lines, CAST(min(line_no) AS BIGINT) AS first_line FROM i GROUP BY doc_id, island"
)
def gaps_islands_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of table lines and other lines of each document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("t", F.contains("line", F.lit("|")))
    runs = sequences.change_islands(lines, ["t"], partition=["doc_id"], order=["line_no"])
    return runs.groupBy("doc_id", "island").agg(F.max("t").alias("is_table"), F.count("*").alias("n_lines"), F.min("line_no").cast("long").alias("first_line"))


@query(
    "WITH o AS (SELECT c_custkey AS doc_id, o_orderkey AS line_no, c_name, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS head FROM orders JOIN customer ON c_custkey = o_custkey), "
    "h AS (SELECT *, min(head) OVER (PARTITION BY doc_id) AS one, max(head) OVER (PARTITION BY doc_id ORDER BY line_no) AS last FROM o) "
    "SELECT c_custkey AS doc_id, CAST(-1 AS BIGINT) AS line_no, c_name AS path FROM customer UNION ALL SELECT doc_id, line_no, concat_ws(' > ', c_name, CASE WHEN last IS NOT NULL THEN one END, nullif(last, one)) FROM h"
)
def heading_stack_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section paths where heading levels are skipped: a customer's name, under it open orders two levels deeper, closed ones as text."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.concat(F.when(F.col("o_orderstatus") == "F", "order ").otherwise("### "), "o_orderkey").alias("line"))
    titles = customers.select("doc_id", F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("# "), "c_name").alias("line"))
    lines = titles.unionByName(orders.join(customers, "doc_id", "left_semi"))
    return sequences.heading_paths(lines).select("doc_id", "line_no", "path")


@query(
    "WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) // 4 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), "
    "r AS (SELECT conv_id, turn, i, s AS total, 0 AS g FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.turn, c.i, CASE WHEN r.total + c.s > 60 THEN c.s ELSE r.total + c.s END, CASE WHEN r.total + c.s > 60 THEN r.g + 1 ELSE r.g END FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1) "
    'SELECT conv_id, turn, g AS "group" FROM r'
)
def greedy_merge_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns merged while they fit 60 tokens."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("size"))
    return sequences.greedy_groups(rows, partition=["conv_id"], order="turn", size="size", budget=60).select("conv_id", "turn", "group")


@query("SELECT o_orderkey FROM orders WHERE (year(o_orderdate), quarter(o_orderdate)) IN ((1998, 2), (1998, 1), (1997, 4))")
def temporal_filter_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quarters that a question means, as exact pairs."""
    asked = spark.createDataFrame([("최근 3분기 실적",)], "question string").select(temporal("question", dt.date(1998, 5, 15)).alias("t"))
    orders = table(spark, sf_dir, "orders")
    when = F.col("o_orderdate")
    joined = orders.join(F.broadcast(asked))
    return joined.where(temporal_filter(F.col("t"), F.year(when), F.quarter(when), F.date_format(when, "yyyyMMdd"))).select("o_orderkey")


@query("SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    sessions = rows.select(F.col("conv_id").alias("id")).distinct()
    messages = rows.select(F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("timestamp"))
    out = chat.session_messages(sessions, messages)
    return out.select(F.col("id").alias("conv_id"), F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", -1)["timestamp"].alias("last_turn"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("SELECT user_id AS id, max(ts) AS updated_at, min(event_type) FILTER (ts = m) AS title FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of each session in an append-only log."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("title"))
    log = events.select(F.col("user_id").alias("id"), "title", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return chat.latest_sessions(log).select("id", "updated_at", "title")


@query("WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, text, answer FROM n WHERE role = 'user' AND nr = 'assistant'")
def question_answer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text", "answer")


_RANKS = {"easy": 1, "medium": 2, "hard": 3}


@query(
    "WITH u AS (SELECT c_custkey AS user_id, CAST((c_custkey >> s) & 1 AS BOOLEAN) AS ok, s + 1 AS step FROM customer, range(5) r(s)), w AS (SELECT user_id, ok, step, coalesce(sum(CASE WHEN ok THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead FROM u), "
    "d AS (SELECT *, CASE WHEN lead < 0 THEN 1 WHEN lead = 0 THEN 2 ELSE 3 END AS rank FROM w), s AS (SELECT user_id, CAST(sum(ok::INT) AS BIGINT) AS n_correct, coalesce(max(rank) FILTER (ok), 0) AS top_rank FROM d GROUP BY user_id) "
    "SELECT user_id, n_correct, top_rank, CASE WHEN top_rank >= 3 AND n_correct >= 3 THEN 'advanced' WHEN top_rank >= 2 AND n_correct >= 2 THEN 'intermediate' ELSE 'beginner' END AS level FROM s"
)
def quiz_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-step adaptive quiz; each user answers by the bits of their key."""
    names = [(s, n) for s in range(1, 6) for n in range(-(s - 1), s, 2)]
    questions = spark.createDataFrame([(f"q{s}_{n}", 1, "easy" if n < 0 else "medium" if n == 0 else "hard") for s, n in names], "question string, answer int, difficulty string")
    edges = [(s, f"q{s}_{n}", ok, f"q{s + 1}_{n + (1 if ok else -1)}") for s, n in names if s < 5 for ok in (True, False)]
    transitions = spark.createDataFrame(edges, "step int, current string, correct boolean, next string")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    steps = F.explode(F.array(*[F.struct(F.lit(f"q{s}_{n}").alias("question"), F.shiftright("user_id", s - 1).bitwiseAND(F.lit(1)).cast("int").alias("choice")) for s, n in names]))
    answers = users.select("user_id", steps.alias("a")).select("user_id", "a.*")
    return quiz.levels(quiz.walk(answers, transitions, questions, "q1_0"), _RANKS)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows; the same function takes a stream with a watermark."""
    return increments.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, g")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return increments.sessions(table(spark, sf_dir, "events"), gap="6 hours")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 64 AS dimension FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND len(list_filter(regexp_extract_all(lower(text), '[가-힣a-zA-Z0-9]+'), lambda w: len(w) >= 2)) > 0")
def incremental_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one increment embeds: only chunks without an embedding of the model."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("natural_text"))
    done = table(spark, sf_dir, "embeddings").select(F.lit("hashing").alias("model"), F.col("vec_id").cast("string").alias("chunk_id"))
    return increments.embed_pending(chunks, done).select("chunk_id", F.size("embedding").alias("dimension"))


@query("SELECT n_name, o_orderpriority, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL")
def star_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and priority: filters reach the scan, small dimensions are broadcast by the planner."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= '1996-01-01' and o_orderdate < '1998-01-01'")
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines after the finished orders are deleted, by customer."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders, lines = dedupe.delete_cascade(orders, orders.where("o_orderstatus = 'F'"), ["o_orderkey"], lines)
    each = lines.groupBy("o_orderkey").agg(F.count("*").alias("lines"))
    return orders.join(each, "o_orderkey", "left").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 25")
def ordered_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty orders from the 26th by price."""
    return sequences.rows_between(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], offset=25, most=40).select("o_orderkey", "o_totalprice")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value > 1) AS succeeded, count(*) FILTER (value IS NULL OR value <= 1) AS failed, count(*) FILTER (value > 1) > 0.5 * count(*) AS accepted FROM events GROUP BY user_id")
def batch_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad rows of each batch, a batch being a user's events."""
    return increments.tallied(table(spark, sf_dir, "events"), F.col("value") > 1, ["user_id"])


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id, event_type")
def upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events in a bucketed table, the other half put into it; the later row of each key stays."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    stored = BucketedTable(working_folder(spark, "events"), ("user_id", "event_type"), ("ts", "event_id"), buckets=16)
    stored.create(events.where("event_id % 2 = 0"))
    stored.upsert(events.where("event_id % 2 = 1"))
    return stored.read(spark)


@query("SELECT 'events' AS run, count(*) AS rows, count(*) FILTER (value > 1) AS succeeded, count(*) FILTER (value IS NULL OR value <= 1) AS failed FROM events")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, good and bad ones of a run, counted by the job that writes the good ones."""
    path = working_folder(spark, "run")
    observed.write_observed(table(spark, sf_dir, "events"), f"{path}/rows", f"{path}/statistics", run="events", valid=F.col("value") > 1)
    return observed.statistics_of(spark, f"{path}/statistics").select("run", "rows", "succeeded", "failed")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 40 AND 45")
def variant_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties stored as VARIANT, their frequent path as a column that prunes the scan."""
    path = working_folder(spark, "variants")
    variants.write(table(spark, sf_dir, "events"), path, json="props", columns={"k": ("$.k", "bigint")}, by="k")
    return spark.read.parquet(path).where("k between 40 and 45").select("event_id", "event_type", variants.at("$.k", "bigint").alias("k"))


@query("SELECT '$.' || key AS path, count(*) AS rows FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the properties with the number of rows that have it."""
    return variants.paths(variants.parsed(table(spark, sf_dir, "events"), "props"), key="event_id").groupBy("path").agg(F.sum("rows").alias("rows"))
