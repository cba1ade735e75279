"""How well blocking and ranking keep the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import blocking, pairs

CAPS = (60, 80, 100, 120, 150, 200, 300)
QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def before_and_after_cap(raw: DataFrame, truth: DataFrame, most: int, *by: str) -> DataFrame:
    """Recall of all candidates and of the capped ones; raw is labelled. ``by`` names columns of truth to group by."""
    one = pairs.recall(raw, truth, *by).withColumn("stage", F.lit("pre_cap"))
    return one.unionByName(pairs.recall(blocking.top_candidates(raw, most), truth, *by).withColumn("stage", F.lit("post_cap")))


def candidate_coverage(raw: DataFrame, records: DataFrame) -> DataFrame:
    """For each country: entities with candidates, and candidates."""
    each = raw.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).join(records.select("entity_id", "country"), "entity_id")
    return each.groupBy("country").agg(F.count(F.lit(1)).alias("entities_with_candidates"), F.sum("n").alias("candidates"))


def recall_of_found(raw: DataFrame, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """cap, found, found_by_blocking, recall: what a cap leaves of the true pairs that blocking found."""
    total = F.broadcast(raw.agg(F.sum("label").alias("found_by_blocking")))
    share = F.when(F.col("found_by_blocking") > 0, F.round(F.col("found") / F.col("found_by_blocking"), 6))
    return _at_caps(blocking.ranked(raw), caps).crossJoin(total).select("cap", "found", "found_by_blocking", share.alias("recall"))


def _at_caps(ranked: DataFrame, caps: tuple[int, ...]) -> DataFrame:
    """cap, candidates, found: sums of one pass over ranked pairs, a few numbers a task."""
    within = [F.sum(F.when(F.col("rank") <= c, v)).alias(f"{n}{c}") for c in caps for n, v in (("n", F.lit(1)), ("f", F.col("label")))]
    rows = [F.struct(F.lit(c).alias("cap"), F.coalesce(F.col(f"n{c}"), F.lit(0)).alias("candidates"), F.coalesce(F.col(f"f{c}"), F.lit(0)).alias("found")) for c in caps]
    return ranked.agg(*within).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("candidates > 0")


def cap_sweep(raw: DataFrame, truth: DataFrame, entities: DataFrame, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """cap, candidates, their mean over all entities, found, recall: ranked once, summed once."""
    totals = truth.distinct().agg(F.count(F.lit(1)).alias("total_true")).crossJoin(entities.select("entity_id").distinct().agg(F.count(F.lit(1)).alias("n")))  # one row each
    rows = _at_caps(blocking.ranked(raw), caps).crossJoin(F.broadcast(totals))
    return rows.select(
        "cap", "candidates", F.round(F.col("candidates") / F.col("n"), 6).alias("mean_candidates"), "found", "total_true",
        F.when(F.col("total_true") > 0, F.round(F.col("found") / F.col("total_true"), 6)).alias("recall"),
    )


def rank_analysis(raw: DataFrame) -> DataFrame:
    """One row: the true pairs' ranks (exact quantiles, moments) and how many have one key or more."""
    true = blocking.ranked(raw).where("label = 1")
    quantiles = [F.round(F.percentile("rank", q), 6).alias(f"rank_p{round(q * 100)}") for q in QUANTILES]
    return true.agg(
        F.count(F.lit(1)).alias("true_pairs"), F.round(F.avg("rank"), 6).alias("rank_mean"), F.round(F.stddev_samp("rank"), 6).alias("rank_std"), F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"), *quantiles, F.round(F.percentile("rank", 0.25), 6).alias("rank_p25"),
        F.sum((F.col("n_keys") == 1).cast("long")).alias("single_key"), F.sum((F.col("n_keys") >= 2).cast("long")).alias("multi_key"),
    )


def keys_histogram(raw: DataFrame) -> DataFrame:
    return raw.where("label = 1").groupBy("n_keys").agg(F.count(F.lit(1)).alias("true_pairs"))


def tie_groups(raw: DataFrame) -> DataFrame:
    """For each n_keys: true pairs, and where they stand among pairs of their entity with as many keys."""
    w = Window.partitionBy("entity_id", "n_keys")
    rows = raw.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy("candidate_id")))
    return rows.where("label = 1").groupBy("n_keys").agg(
        F.count(F.lit(1)).alias("true_pairs"), F.round(F.percentile("size", 0.5), 6).alias("tie_size_median"),
        F.round(F.percentile("place", 0.5), 6).alias("tie_place_median"), F.round(F.percentile("place", 0.9), 6).alias("tie_place_p90"),
    )


def recall_at(raw: DataFrame, truth: DataFrame, caps: tuple[int, ...], *order) -> DataFrame:
    """cap, found, recall with the pairs in a given order."""
    total = F.broadcast(truth.distinct().agg(F.count(F.lit(1)).alias("total_true")))
    rows = _at_caps(blocking.ranked(raw, *order), caps).crossJoin(total)
    return rows.select("cap", "found", F.when(F.col("total_true") > 0, F.round(F.col("found") / F.col("total_true"), 6)).alias("recall"))


def recall_of_ranks(ranked: DataFrame, truth: DataFrame, caps: tuple[int, ...]) -> DataFrame:
    """cap, found, recall of true pairs whose ranks among all candidates are known."""
    sums = ranked.agg(*[F.count_if(F.col("rank") <= c).alias(f"f{c}") for c in caps])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"f{c}").alias("found")) for c in caps])).alias("r")).select("r.*")
    total = F.broadcast(truth.distinct().agg(F.count(F.lit(1)).alias("total_true")))
    return rows.crossJoin(total).select("cap", "found", F.when(F.col("total_true") > 0, F.round(F.col("found") / F.col("total_true"), 6)).alias("recall"))


def tie_upper_bound(raw: DataFrame, truth: DataFrame, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """The recall if ties were always resolved for the truth."""
    return recall_at(raw, truth, caps, F.desc("n_keys"), F.desc("label"))
