"""Lists of ids an entity, and what must hold of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_lists(entities: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """source1_entity_id and the sorted distinct candidates, comma-joined; every entity once, an empty string without any."""
    lists = pairs.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_id")), ",").alias(name))
    return entities.select("entity_id").distinct().join(lists, "entity_id", "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def candidate_lists(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    return id_lists(entities, pairs, "candidate_entity_ids")


def match_lists(entities: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    return id_lists(entities, scored.where(F.col("score") >= threshold), "matched_entity_ids")


def violations(entities: DataFrame, pairs: DataFrame, scored: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """One row of counts that must be zero: repeated entities, unknown matches, matches that are no candidates."""
    matched = scored.where(F.col("score") >= threshold).select("entity_id", "candidate_id").distinct()
    valid = records.where("source IN (2, 3)").where(F.substring("entity_id", 1, 3) == F.concat(F.lit("S"), F.col("source"), F.lit("-"))).select(F.col("entity_id").alias("candidate_id"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    repeated = count(entities.groupBy("entity_id").count().where("count > 1"), "repeated_entities")
    unknown = count(matched.join(valid, "candidate_id", "left_anti"), "unknown_matches")
    stray = count(matched.join(pairs, ["entity_id", "candidate_id"], "left_anti"), "matches_not_candidates")
    return repeated.crossJoin(unknown).crossJoin(stray)  # one row each


def build(entities: DataFrame, pairs: DataFrame, scored: DataFrame, records: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Both lists; raises ValueError if something must not be."""
    bad = {k: v for k, v in violations(entities, pairs, scored, records, threshold).first().asDict().items() if v}
    if bad:
        raise ValueError(f"invalid output: {bad}")
    return candidate_lists(entities, pairs), match_lists(entities, scored, threshold)


def match_rate(lists: DataFrame) -> DataFrame:
    """One row: entities, and the share with a match."""
    return lists.agg(F.count(F.lit(1)).alias("entities"), F.avg((F.col("matched_entity_ids") != "").cast("double")).alias("match_rate"))
