"""The operators of this package on the tables of a data folder, with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import (
    op1_token_packing,
    op2_latent_decontam,
    op3_order_minhash,
    op4_quality_qda,
    op5_source_mix,
    op6_license_scan,
    op7_substring_dedup,
    op8_language_id,
    op9_html_mincut,
    op10_embedding_lsh,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op7_substring_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    out = op7_substring_dedup.removed(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_token_packing_query(spark: SparkSession, folder: str) -> DataFrame:
    return op1_token_packing.packed(_table(spark, folder, "documents"))


def op2_latent_decontam_query(spark: SparkSession, folder: str) -> DataFrame:
    return op2_latent_decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_order_minhash_query(spark: SparkSession, folder: str) -> DataFrame:
    return op3_order_minhash.near_duplicates(_table(spark, folder, "documents"))


def op4_quality_qda_query(spark: SparkSession, folder: str) -> DataFrame:
    return op4_quality_qda.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_source_mix_query(spark: SparkSession, folder: str) -> DataFrame:
    out = op5_source_mix.mixed(_table(spark, folder, "documents"))
    shards = F.concat("whole", F.when(F.col("rest") > 0, F.array("rest_shard")).otherwise(F.array())).alias("shards")
    return out.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", shards)


def op6_license_scan_query(spark: SparkSession, folder: str) -> DataFrame:
    return op6_license_scan.scanned(_table(spark, folder, "documents"))


def op8_language_id_query(spark: SparkSession, folder: str) -> DataFrame:
    return op8_language_id.identified(_table(spark, folder, "documents"))


def op9_html_mincut_query(spark: SparkSession, folder: str) -> DataFrame:
    return op9_html_mincut.extracted(_table(spark, folder, "pages"))


def op10_embedding_lsh_query(spark: SparkSession, folder: str) -> DataFrame:
    return op10_embedding_lsh.linked(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_packing": op1_token_packing_query,
    "op2_latent_decontam": op2_latent_decontam_query,
    "op3_order_minhash": op3_order_minhash_query,
    "op4_quality_qda": op4_quality_qda_query,
    "op5_source_mix": op5_source_mix_query,
    "op6_license_scan": op6_license_scan_query,
    "op7_substring_dedup": op7_substring_dedup_query,
    "op8_language_id": op8_language_id_query,
    "op9_html_mincut": op9_html_mincut_query,
    "op10_embedding_lsh": op10_embedding_lsh_query,
}

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
win AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS r FROM pos),
dead AS (SELECT doc_id, list(DISTINCT s + i) AS p FROM win, range(0, 20) t(i) WHERE r > 1 GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(p, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN dead ON d.doc_id = dead.doc_id
"""

OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT r.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a)::BIGINT AS n_links, min(r.b)::BIGINT AS component_id, r.a = min(r.b) AS kept FROM reach r GROUP BY r.a
"""

ORACLES: dict[str, str] = {"op10_embedding_lsh": OP10_SQL, "op7_substring_dedup": OP7_SQL}
