"""Tab-separated records: every column a string, the empty string for missing, NA and NULL as they stand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of a file with a header; ``wanted`` prunes them at the scan."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).options(sep="\t", header=True, escape='"', multiLine=True).csv(path).na.fill("")
    return df.select(*(wanted or columns))


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """With a header; empty strings as nothing, quotes doubled. One file a task: at scale a folder of parts."""
    df.write.mode(mode).options(sep="\t", header=True, emptyValue="", escape='"').csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results with a header, comma-separated."""
    df.write.mode(mode).options(header=True, escape='"').csv(path)


def to_parquet(spark: SparkSession, path: str, out: str, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """Writes a file as Parquet once, with all columns, and reads that."""
    read_tsv(spark, path, columns).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def load_sources(spark: SparkSession, root: str, split: str = "train") -> tuple[DataFrame, DataFrame | None]:
    """The records of the three sources with their number as source, and (for train) the truth."""
    parts = [read_tsv(spark, f"{root}/{split}/{split}_source{k}.tsv").withColumn("source", F.lit(k)) for k in (1, 2, 3)]
    truth = read_tsv(spark, f"{root}/{split}/{split}_ground_truth.tsv", TRUTH) if split == "train" else None
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), truth


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows by an order: a distributed table has none of its own."""
    return df.orderBy(*order).limit(n)


def folder_name(country: str) -> str:
    """A country as part of a path."""
    return re.sub(r"[^\w.-]+", "_", country.strip()) or "UNKNOWN"


def write_stage(df: DataFrame, path: str, by: tuple[str, ...] = (), clean: bool = False) -> None:
    """A stage's rows as Parquet; refuses to mix them with what is there unless ``clean`` replaces it."""
    df.write.mode("overwrite" if clean else "errorifexists").partitionBy(*by).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", False).parquet(path)
