"""Macro F-beta of id sets, and the threshold that maximises it.

Every entity counts, also those without truth or prediction. The curve over all thresholds takes one pass: each pair falls into the
bucket of grid thresholds its score reaches, buckets are summed an entity, and cumulative sums give every threshold's
counts; no pair is compared with nineteen thresholds, and nothing but the curve leaves the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = tuple(round(0.05 * k, 2) for k in range(1, 20))


def f_beta(n_true: Column, n_pred: Column, hits: Column, beta: float = 0.5) -> Column:
    """1 if nothing is true and nothing predicted, 0 if one of these only."""
    p, r = hits / n_pred, hits / n_true
    value = (1 + beta**2) * p * r / (beta**2 * p + r)
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when((n_pred == 0) | (hits == 0), F.lit(0.0)).otherwise(value)


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs whose score is at least the threshold."""
    return scored.where(F.col("score") >= threshold).select("entity_id", "candidate_id").distinct()


def entity_scores(entities: DataFrame, truth: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """entity_id, n_true, n_pred, hits, f_beta of every entity."""
    marks = truth.select("entity_id", "candidate_id").distinct().withColumn("t", F.lit(1)).join(
        predicted.select("entity_id", "candidate_id").distinct().withColumn("p", F.lit(1)), ["entity_id", "candidate_id"], "full"
    )
    counts = marks.groupBy("entity_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.sum(F.coalesce("t", F.lit(0)) * F.coalesce("p", F.lit(0))).alias("hits"))
    rows = entities.select("entity_id").distinct().join(counts, "entity_id", "left").na.fill(0, ["n_true", "n_pred", "hits"])
    return rows.withColumn("f_beta", f_beta(F.col("n_true"), F.col("n_pred"), F.col("hits"), beta))


def macro_f_beta(entities: DataFrame, truth: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row: entities, macro_f_beta (0 without entities)."""
    rows = entity_scores(entities, truth, predicted, beta)
    return rows.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.avg("f_beta"), F.lit(0.0)).alias("macro_f_beta"))


def threshold_curve(entities: DataFrame, truth: DataFrame, scored: DataFrame, beta: float = 0.5, grid: tuple[float, ...] = GRID) -> DataFrame:
    """threshold, macro_f_beta for each of the grid. Of repeated pairs the highest score counts."""
    reached = sum(((F.col("score") >= t).cast("int") for t in grid), F.lit(0))
    best = scored.groupBy("entity_id", "candidate_id").agg(F.max("score").alias("score"))
    true = truth.select("entity_id", "candidate_id").distinct()
    marks = best.join(true.withColumn("t", F.lit(1)), ["entity_id", "candidate_id"], "left").withColumn("reached", reached)
    steps = marks.where("reached > 0").groupBy("entity_id", "reached").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("h"))
    down = Window.partitionBy("entity_id").orderBy(F.desc("reached"))
    steps = steps.select("entity_id", "reached", F.sum("n").over(down).alias("n_pred"), F.sum("h").over(down).alias("hits"), F.lead("reached", 1, 0).over(down).alias("below"))
    size = entities.select("entity_id").distinct().join(true.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_true")), "entity_id", "left").na.fill(0, ["n_true"])
    # A step's counts hold for the thresholds numbered below + 1 to reached.
    held = steps.join(size, "entity_id").withColumn("k", F.explode(F.sequence(F.col("below") + 1, F.col("reached"))))
    held = held.withColumn("gain", f_beta(F.col("n_true"), F.col("n_pred"), F.col("hits"), beta) - (F.col("n_true") == 0).cast("double"))
    gains = held.groupBy("k").agg(F.sum("gain").alias("gain"))
    base = size.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum((F.col("n_true") == 0).cast("double")), F.lit(0.0)).alias("base"))
    points = entities.sparkSession.createDataFrame([(k, t) for k, t in enumerate(grid, 1)], "k int, threshold double")
    rows = F.broadcast(points).join(gains, "k", "left").crossJoin(F.broadcast(base))  # nineteen rows and one
    value = F.when(F.col("entities") == 0, F.lit(0.0)).otherwise((F.col("base") + F.coalesce("gain", F.lit(0.0))) / F.col("entities"))
    return rows.select("threshold", value.alias("macro_f_beta"))


def best_threshold(curve: DataFrame, digits: int = 9) -> DataFrame:
    """One row: the first threshold of the highest value."""
    return curve.withColumn("v", F.round("macro_f_beta", digits)).orderBy(F.desc("v"), "threshold").limit(1).select("threshold", F.col("v").alias("macro_f_beta"))
