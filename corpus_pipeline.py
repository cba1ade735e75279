"""A training corpus from documents: quality, near duplicates, contamination, mix, packed ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import op1_token_packing, op2_latent_decontam, op3_order_minhash, op4_quality_qda, op5_source_mix
from kinfold.llm.common import keep


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the key's name: doc_id may be null or repeat. Kept, so that every reader sees the same keys."""
    key = "row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality discriminant accepts, whole and as they are.

    Null and empty texts have statistics and so a score; a score at the threshold is accepted; repeated rows share their score. Without usable
    labels every score is 0.5 and all rows stay. Rows with a null doc_id are judged and not learnt from. An empty table stays empty, other columns
    stay whatever their names.
    """
    return op4_quality_qda.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that of the smallest doc_id; rows without a doc_id are in no class and stay.

    Rows are compared by their texts, so different texts under one doc_id all stay. Of rows that share the smallest doc_id of a class the first
    by a hash of text, source and lang stays, then the first in the table, so reruns over the same files agree. Null, empty and wordless texts are in no class
    but their own and stay. An empty table stays empty, other columns stay whatever their names.
    """
    rows, key = _rows(docs.where("doc_id IS NOT NULL"))
    found = op3_order_minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "class_id")
    named = rows.select(key, "doc_id", F.xxhash64("text", "source", "lang").alias("kind"))
    first = found.join(named, key).groupBy("class_id").agg(F.min(F.struct("doc_id", "kind", key)).alias("first"))
    stay = rows.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_semi")
    return stay.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item stands, whatever their doc_id.

    Null and empty texts hold no item and stay; repeated rows go or stay together; rows with a null doc_id are judged by their own text. An empty
    table or benchmark takes nothing out. Other columns stay whatever their names.
    """
    rows, key = _rows(docs)
    found = op2_latent_decontam.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = keep(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return rows.join(found, key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a row for each copy taken, in shuffled shards.

    A null source is a source, the last; rows without words stay with their block; repeated rows and null ids are drawn like others. The
    document that a target cuts keeps its leading words. Reruns agree; an empty table stays empty; other columns stay whatever their names.
    """
    return op5_source_mix.shuffled(docs)


def packed_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids.

    Null and empty texts give no tokens; overlong ones are split without loss; repeated rows are packed as often as they occur. Which texts share a row
    follows the files of docs; an empty table gives no rows, other columns are ignored.
    """
    return op1_token_packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("packed_ids", packed_ids),
]

#: SQL can express none of the models and sketches; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
