"""The queries that apply the operators to the ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.llm import collocations, decontaminate, exact_dedup, lang_id, lm_score, mixing, ngram_join, quality, resample, secrets, sharding, toxicity, vector_dedup
from brinework.llm._shared import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), (F.col("toxicity") >= F.col("toxicity_threshold")).alias("rejected"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), _table(spark, sf_dir, "labels")
    out = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir), keep="max")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs)).select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    kinds = {f"n_{k}": count(k) for k in secrets.KINDS[:3]}
    base = F.filter("secrets", lambda x: x["kind"] != "markov")
    return found.select("doc_id", *[c.alias(k) for k, c in kinds.items()], F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_docs(spark, sf_dir))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_docs(spark, sf_dir)).drop("bytes")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = lang_id.predict(docs.select("doc_id", "text"), lang_id.fit(docs))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _docs(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard(rows, 40, text="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_dedup(_table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_quality, op3_exact_dedup, op4_decontaminate, op5_mix_sources, op6_secrets, op7_ngram_join, op8_lm_scores, op9_language, op10_shard, op11_collocations, op12_vector_dedup, op13_resample)
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256,
               CAST(octet_length(encode(d.t)) AS BIGINT) AS n_bytes
        FROM d JOIN g USING (t)
    """,
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        pieces AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM p),
        places AS (SELECT lang, id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w1 FROM pieces),
        runs AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM places WINDOW o AS (PARTITION BY id ORDER BY i)),
        f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
        f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
        f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS cut, x.f AS l, y.f AS r, NULL AS none
                 FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 10
                 UNION ALL SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.f, 1, x.f, y.f, NULL
                 FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
                 UNION ALL SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.f, 2, x.f, y.f, NULL
                 FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
        scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
        best AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        around AS (SELECT lang, phrase, max(f) AS longest
                   FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best LEFT JOIN around USING (lang, phrase) JOIN n USING (lang)
        WHERE longest IS NULL OR 100 * longest < 50 * a
        QUALIFY rank <= 2000
    """,
    "op12_vector_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
              WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95),
        reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least ON least.x = vec_id LEFT JOIN n ON n.x = vec_id
    """,
    # crc32 is the exclusive or of what each byte adds by its distance from the end, and of a number for the length
    "op13_resample": r"""
        WITH RECURSIVE
        shifted(b, c, k) AS (SELECT range, range, 0 FROM range(256)
                             UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifted WHERE k < 8),
        tab AS MATERIALIZED (SELECT b, c FROM shifted WHERE k = 8),
        texts AS (SELECT doc_id, rowid_ AS r, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS parts
                  FROM (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM documents
                        UNION ALL SELECT NULL, text, -row_number() OVER () FROM benchmark)),
        words AS (SELECT doc_id, r, list_filter(parts, lambda w: w <> '') AS ws FROM texts),
        places AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM words),
        following AS (SELECT r, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM places WINDOW p AS (PARTITION BY r ORDER BY i)),
        features AS MATERIALIZED (SELECT r, w1 AS f FROM following UNION ALL SELECT r, w1 || ' ' || w2 FROM following WHERE w2 IS NOT NULL
                     UNION ALL SELECT r, w1 || ' ' || w2 || ' ' || w3 FROM following WHERE w3 IS NOT NULL),
        names AS MATERIALIZED (SELECT DISTINCT f, hex(encode(f)) AS h FROM features),
        longest AS (SELECT max(len(h) // 2) AS m FROM names),
        adds(b, d, c) AS (SELECT b, 0, c FROM tab
                          UNION ALL SELECT a.b, a.d + 1, xor(a.c >> 8, t.c) FROM adds a JOIN tab t ON t.b = a.c & 255 WHERE a.d < (SELECT m FROM longest)),
        begins(n, z) AS (SELECT 0, 4294967295::BIGINT
                         UNION ALL SELECT n + 1, xor(z >> 8, t.c) FROM begins JOIN tab t ON t.b = z & 255 WHERE n < (SELECT m FROM longest)),
        spread AS (SELECT f, len(h) // 2 AS n, unnest(range(len(h) // 2)) AS j, h FROM names),
        crcs AS (SELECT s.f, bit_xor(a.c) AS c, any_value(s.n) AS n
                 FROM spread s JOIN adds a ON a.d = s.n - 1 - s.j AND a.b = ('0x' || substr(s.h, 2 * s.j + 1, 2))::BIGINT GROUP BY s.f),
        buckets AS (SELECT f, xor(xor(c, z), 4294967295) % 10000 AS bucket FROM crcs JOIN begins USING (n)),
        placed AS MATERIALIZED (SELECT r, bucket FROM features JOIN buckets USING (f)),
        counts AS (SELECT bucket, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM placed GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts),
        gains AS (SELECT bucket, floor(1000.0 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
        sums AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE r > 0 GROUP BY r),
        scored AS (SELECT w.doc_id, w.r, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
                   FROM words w LEFT JOIN sums USING (r) WHERE w.r > 0),
        fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n >= 20)
        SELECT doc_id, n_features, weight, score, rank
        FROM scored LEFT JOIN (SELECT r, rank FROM fit WHERE rank <= (SELECT count(*) * 5 // 100 FROM fit)) USING (r)
    """,
}
