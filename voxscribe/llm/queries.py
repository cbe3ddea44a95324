"""The registered queries of the corpus operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxscribe.llm import embedding_dedup, html_text, licenses, lm, mixing, packing, quality, simhash, topk, toxicity
from voxscribe.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "rejected")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary_files() -> dict[str, str]:
    """The public 50k byte-level vocabulary: as the tokenizer's file, and as ranks with their pattern."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **vocabulary_files())


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op9_lm, which SQL can express."""
    out = op9_lm(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def _crc32_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of an ASCII text: eight shifts a byte."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {step}, xor(a, b))"
    return f"xor(list_reduce(list_transform(range(len({text})), lambda i: ascii(substr({text}, i + 1, 1))::BIGINT), lambda a, b: {byte}, 4294967295::BIGINT), 4294967295)"


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_html": op5_html,
    "op6_topk": op6_topk,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_lm": op9_lm,
    "op10_embedding_dedup": op10_embedding_dedup,
    "lm_base_scores": lm_base_scores,
}
ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.oracle_sql(),
    "op2_mixing": mixing.oracle_sql(),
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
        e AS (SELECT p.r AS a, q.r AS b FROM ok AS p JOIN ok AS q ON p.label = q.label AND p.r <> q.r AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
        reach AS (SELECT r, r AS m FROM v UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.m),
        c AS (SELECT reach.r, min(w.vec_id) AS component_id FROM reach JOIN v AS w ON w.r = reach.m GROUP BY reach.r),
        n AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
    """,
    "lm_base_scores": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 10 = 0 AS held_out,
            list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS tokens FROM documents),
        t AS (SELECT r, doc_id, held_out, unnest(tokens) AS w FROM d),
        c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
        FROM t LEFT JOIN c USING (w), s GROUP BY r, doc_id, held_out
    """,
}
