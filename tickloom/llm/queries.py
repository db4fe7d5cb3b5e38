"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    chat,
    decontaminate,
    hard_negatives,
    html_main,
    language,
    lexical,
    mixing,
    permutation,
    run_index,
    simhash,
    topk,
    toxicity,
    warc,
)
from tickloom.llm.common import fold, landed, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Fitted on the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), 4) != 2)
    return toxicity.fitted(docs.where(fold(F.col("doc_id"), 4) != 2), labels)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity_model(spark, docs, sf_dir), "score")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_archives", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d""")
def op2_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_chat_formatting", r"""
    WITH c AS (SELECT conv_id, turn, role, text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 coalesce(lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> coalesce(role, ''), true) AS opens FROM c),
    e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS n_text,
                 length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) AS n_role FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(n_text + CASE WHEN opens THEN n_role + 12 + 1 + 11 ELSE 11 END)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id""")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    out = chat.formatted(turns).withColumn("turns", chat.read_turns(F.col("formatted")))
    out = out.withColumn("trained", chat.read_trained(F.col("formatted"), F.col("mask")))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
                      F.char_length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op4_exact_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END::BIGINT AS score
          FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors, k=5)


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fitted(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = language.predicted(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.main_text(pages, html_main.fitted(pages))


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.indexes(table(spark, sf_dir, "benchmark"))
    return decontaminate.matches(table(spark, sf_dir, "documents"), index)


MIX_SQL = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, '')) AS h FROM {docs}),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM s),
    w AS (SELECT *, no % 3 AS class, no % 3 + 1 AS weight, 3 * source_size AS most FROM n),
    r AS (SELECT *, most / weight AS ratio FROM w),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY ratio, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
    t AS (SELECT *, CASE WHEN ratio <= lowest THEN most::DOUBLE ELSE lowest * weight END AS target
          FROM (SELECT *, (SELECT arg_min(level, (ratio, no)) FROM l WHERE level <= ratio) AS lowest FROM l)),
    c AS (SELECT d.*, t.source_size, t.target, t.class, least(floor(target / greatest(t.source_size, 1)), 3)::BIGINT AS passes,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY {order}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, CASE WHEN passes < 3 THEN greatest(least(greatest(round(target - passes * source_size)::BIGINT, 0) - ahead, size), 0) ELSE 0 END AS part FROM c),
    g AS (SELECT *, size * passes + part AS taken,
                 CASE WHEN size > 0 THEN passes + (part > 0)::BIGINT ELSE 0 END AS copies,
                 least((ahead + CASE WHEN passes > 0 THEN size ELSE part END / 2) / target, 1.0) AS u,
                 CASE class WHEN 0 THEN -0.6::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 0.6::DOUBLE END AS slope FROM p),
    f AS (SELECT *, CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN u
                 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END END AS position FROM g)"""
MIX_ORDER = "('0x' || substr(h, 1, 8))::BIGINT % 4096, h"


@query("op9_mixing", MIX_SQL.format(docs="documents", order=MIX_ORDER) + """
    SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, copies::BIGINT AS copies, position FROM f""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = landed(mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size"), "sizes")
    mixed = landed(mixing.mix(docs), "mixed")
    return mixing.ordered(mixed).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


@query("op10_run_index")
def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digests(table(spark, sf_dir, "documents"))


@query("op11_permutation_index")
def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation.search(vectors.where("vec_id % 20 = 0"), vectors, k=20)


@query("op12_hard_negatives", """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, c.v) END::BIGINT AS score
          FROM v a JOIN v c ON len(a.v) = len(c.v) AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
           s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
    QUALIFY rank <= 10""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.quantized(vectors, "vec_id", "embedding", "label"))


@query("op13_lexical_search", r"""
    WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    d AS (SELECT row_no, doc_id, len(terms)::BIGINT AS n, terms FROM t WHERE len(terms) > 0),
    a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM d),
    f AS (SELECT row_no, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row_no, doc_id, n, unnest(terms) AS term FROM d) GROUP BY row_no, term),
    w AS (SELECT term, floor(1000 * ln((2 * docs::DOUBLE + 2) / (2 * df::DOUBLE + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
    q AS (SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
    s AS (SELECT item_id, text, row_no, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN f USING (term), a GROUP BY item_id, text, row_no),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 10""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
