"""Queries of the training-data operators, each over its whole table.

``QUERIES`` maps a name to ``fn(spark, sf_dir)``; ``ORACLE`` has the matching
DuckDB SQL where SQL can express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .bagminhash import near_dedup
from .common import documents
from .conversation_repair import damage, repair_all
from .exact_dedup import exact_dedup
from .impact_topk import top_k
from .line_dedup import line_dedup
from .mixing import mix
from .quality_knn import KEEP, fit, held_out, score
from .sentencepiece_backend import encode_decode
from .sharding import assign_shards
from .spelling_variants import spelling_variants
from .token_counts import count_tokens
from .token_records import read_records, record_folder, write_records


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select(
        "doc.doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc.doc_id", "score").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
                             record_folder(spark))
    return read_records(manifest)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc.doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op7_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", "ids_crc32", "round_trip",
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon).select("doc.doc_id", "score").select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.FLAG).cast("int").alias("predicted"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_all(conversations, damage(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_knn": op3_quality_knn,
    "op4_token_records": op4_token_records,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_counts": op6_token_counts,
    "op7_impact_topk": op7_impact_topk,
    "op8_shards": op8_shards,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_dedup": op10_near_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op5_mix_sources": r"""
        WITH d AS (
          SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
          FROM documents),
        s AS (
          SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
                 (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS weight
          FROM d GROUP BY src),
        c AS (
          SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
                 coalesce(sum(3 * source_size) OVER w, 0) AS used, coalesce(sum(weight) OVER w, 0) AS gone
          FROM s
          WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE), src
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lv AS (
          SELECT CAST(total - used AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS level, gone, cap, weight FROM c),
        level AS (
          SELECT arg_min(level, gone) AS level FROM lv
          WHERE CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) >= level),
        t AS (
          SELECT src, source_size, least(CAST(cap AS DOUBLE), level * CAST(weight AS DOUBLE)) AS target,
                 CAST(CAST('0x' || substr(md5('mix-1:' || src), 1, 8) AS BIGINT) % 65536 AS DOUBLE) / 65536.0::DOUBLE AS shift
          FROM c, level),
        p AS (
          SELECT d.*, source_size, target, shift,
                 CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate,
                 CAST(row_number() OVER (PARTITION BY d.src ORDER BY size, h, doc_id) AS DOUBLE) AS pos
          FROM d JOIN t USING (src))
        SELECT doc_id, size, source_size, target,
               CAST(least(floor(pos * rate + shift) - floor((pos - 1) * rate + shift), 3) AS BIGINT) * size AS taken
        FROM p
    """,
    "op7_impact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
          SELECT q.vec_id AS query_id, v.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.w, v.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
        r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
