"""Labels, recall, sampling and splits of candidate pairs.

Truth is a table of pairs (entity_id, candidate_id). Whatever is random orders by a hash of ids and a seed, so it does not
depend on partitions; ``ordered_hash`` uses md5, which other engines have as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct pairs of a table of comma-joined id lists; of rows that share an id all count."""
    ids = F.filter(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda i: i != "")
    return truth.select(F.col("source1_entity_id").alias("entity_id"), F.explode(ids).alias("candidate_id")).distinct()


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """With label 1 for pairs of the truth, else 0."""
    true = truth.select("entity_id", "candidate_id", F.lit(1).alias("label")).distinct()
    return pairs.join(true, ["entity_id", "candidate_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def recall(labels: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """What of the truth the pairs hold, in pairs and in entities; ratios are null where nothing could be found.

    ``by`` names columns of both tables to group by. A ratio of sums, not a mean of ratios.
    """
    want = truth.distinct().groupBy("entity_id", *by).agg(F.count(F.lit(1)).alias("n_true"))
    got = labels.groupBy("entity_id").agg(F.sum("label").alias("found"))
    each = want.join(got, "entity_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    whole = each.groupBy(*by).agg(
        F.coalesce(F.sum("n_true"), F.lit(0)).alias("total_true_matches"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("matches_found_in_candidates"),
        F.count(F.lit(1)).alias("entities_with_matches"),
        F.coalesce(F.sum((F.col("found") >= F.col("n_true")).cast("long")), F.lit(0)).alias("entities_fully_recalled"),
    )
    return with_ratios(whole)


def with_ratios(sums: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return sums.withColumn("pair_level_recall", share("matches_found_in_candidates", "total_true_matches")).withColumn(
        "entity_level_full_recall", share("entities_fully_recalled", "entities_with_matches")
    )


def ordered_hash(seed: int, *ids: str) -> Column:
    """Hexadecimal digits that order rows at random, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def uniform(seed: int, *ids: str) -> Column:
    """A number in (0, 1) by hash: 52 bits."""
    return (F.conv(F.substring(ordered_hash(seed, *ids), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sampled(labels: DataFrame, per_positive: int = 6, least: int = 6, seed: int = 42) -> DataFrame:
    """All positives, and of each entity's negatives per_positive for each positive (least if it has none).

    Negatives are drawn without replacement with weight n_keys + 1, by the least of -ln(u) / weight; u is a hash. Positives are
    counted by a partial aggregate, and the ranking keeps only what it returns.
    """
    positives = labels.groupBy("entity_id").agg(F.sum("label").alias("n_pos"))
    most = F.when(F.col("n_pos") > 0, F.col("n_pos") * per_positive).otherwise(F.lit(max(per_positive, least)))
    key = F.round(-F.log(uniform(seed, "entity_id", "candidate_id")) / (F.col("n_keys") + 1), 9)
    negative = labels.where("label = 0").join(positives, "entity_id")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(key, "candidate_id"))
    negative = negative.withColumn("_place", place).where(F.col("_place") <= most).drop("_place", "n_pos")
    return labels.where("label = 1").unionByName(negative)


def split(ids: DataFrame, share: float = 0.15, seed: int = 42, by: str = "country") -> DataFrame:
    """Distinct entities with split 'val' for exactly floor(share * n) of each group, else 'train'. Rows without a group are left out.

    Places count within the 65,536 first digits of the hash, after the sums of those before: no task holds a group's rows.
    """
    place = ordered_hash(seed, "entity_id")
    rows = ids.select("entity_id", by).distinct().withColumn("_digits", F.substring(place, 1, 4))
    whole = Window.partitionBy(by)
    sums = rows.groupBy(by, "_digits").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(whole.orderBy("_digits")) - F.col("_n")).withColumn("_all", F.sum("_n").over(whole))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_digits").orderBy(place, "entity_id"))).join(sums, [by, "_digits"])
    val = F.col("_before") + F.col("_place") <= F.floor(F.col("_all") * share)
    return rows.select("entity_id", by, F.when(val, "val").otherwise("train").alias("split"))


def drawn(rows: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows at random (a distributed top-n by hash)."""
    return rows.orderBy(ordered_hash(seed, *ids), *ids).limit(n)


def aligned_sample(records: DataFrame, truth: DataFrame, entities: int, distractors: int, seed: int = 12345, first: bool = False) -> DataFrame:
    """A sample that agrees with the truth: source-1 records, all records they match, and other records of each source.

    Source-1 records are the first by id or drawn at random. Returns the records with role entity, match or distractor. Raises if a match isn't there.
    """
    one = records.where("source = 1")
    chosen = (one.orderBy("entity_id").limit(entities) if first else drawn(one, entities, seed, "entity_id")).withColumn("role", F.lit("entity"))
    need = truth.join(chosen.select("entity_id"), "entity_id", "left_semi").select(F.col("candidate_id").alias("entity_id")).distinct()
    other = records.where("source <> 1")
    if (lost := need.join(other, "entity_id", "left_anti").count()) > 0:
        raise ValueError(f"{lost} records of the truth are not there")
    match = other.join(need, "entity_id", "left_semi").withColumn("role", F.lit("match"))
    rest = other.join(need, "entity_id", "left_anti")
    out = chosen.unionByName(match)
    for source in (2, 3):
        out = out.unionByName(drawn(rest.where(F.col("source") == source), distractors, seed + source, "entity_id").withColumn("role", F.lit("distractor")))
    return out.dropDuplicates(["entity_id"])


def coverage(records: DataFrame, truth: DataFrame) -> DataFrame:
    """For each source: ids of the truth, and how many of them are records."""
    ids = truth.select(F.col("candidate_id").alias("entity_id"), F.substring("candidate_id", 2, 1).cast("int").alias("source")).distinct()
    found = ids.join(records.select("entity_id").distinct().withColumn("there", F.lit(1)), "entity_id", "left")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("referenced"), F.count("there").alias("found"), (F.count(F.lit(1)) - F.count("there")).alias("missing"))
