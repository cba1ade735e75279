"""Matching of records as they arrive.

The others (sources 2 and 3) are normalised, blocked and capped once, when the stream starts. Each micro-batch of source-1 records adds
its normalised records, postings and counts of keys to the state, a folder ``batch=n`` each, so a repeated batch replaces itself. A
key counts as over the cap by all source-1 records so far; earlier entities that have a key which this batch brings over it are
matched again and written with the batch. The last rows of each entity (``latest``) are therefore those of one batch of all records,
however these were dealt into batches.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators import blocking, features, outputs
from kinfold.operators.blocking import Blocking
from kinfold.plans import models
from kinfold.runtime import keep

_KEY = ["source", "country", "kind", "key"]


def match_stream(arriving: DataFrame, others: DataFrame, model: PipelineModel, threshold: float, out: str, checkpoint: str, cfg: Blocking = Blocking()) -> StreamingQuery:
    """Match lists of a stream of records (source 1) against others (sources 2 and 3), a folder ``batch=n`` each; ``latest`` reads them.

    State lies beside the checkpoint. A record that arrives again under its id is another record of that id.
    """
    known = keep(blocking.normalised(others, cfg.ngram), "others")
    known_keys = keep(blocking.capped(blocking.postings(known, cfg), cfg), "other-keys")
    state = f"{checkpoint}/kinfold"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")
        write(blocking.normalised(batch.select(*others.columns), cfg.ngram), "norm")
        write(blocking.postings(spark.read.parquet(f"{state}/norm/batch={number}"), cfg), "keys")
        write(spark.read.parquet(f"{state}/keys/batch={number}").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")), "counts")
        so_far = lambda name: spark.read.parquet(f"{state}/{name}").where(F.col("batch") <= number)
        norm, keys = so_far("norm").drop("batch"), so_far("keys")
        cap = F.when(F.col("kind") == blocking.KINDS.index("addr_number"), cfg.number_cap).otherwise(cfg.cap)
        counts = so_far("counts").groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("batch") == number, F.col("n"))).alias("now"))
        over = keep(counts.where(F.col("n") > cap).withColumn("new", F.coalesce(F.col("n") - F.col("now") <= cap, F.lit(False))).drop("n", "now"), "over")
        changed = keys.join(over.where("new"), _KEY, "left_semi").where(F.col("batch") < number).select("entity_id")
        due = keep(keys.where(F.col("batch") == number).select("entity_id").unionByName(norm.join(changed, "entity_id", "left_semi").select("entity_id")).unionByName(batch.select("entity_id")).distinct(), "due")
        own = keys.drop("batch").join(due, "entity_id", "left_semi").join(over, _KEY, "left_anti")
        found = blocking.top_candidates(blocking.rendered(blocking.key_pairs(own.unionByName(known_keys))), cfg.most_candidates)
        rows = features.features(found, norm.unionByName(known))
        scored = models.score(model, rows).select("entity_id", "candidate_id", "score")
        outputs.match_lists(due, scored, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last match list of each entity."""
    last = F.row_number().over(Window.partitionBy("source1_entity_id").orderBy(F.desc("batch")))
    return spark.read.parquet(out).withColumn("_last", last).where("_last = 1").drop("_last", "batch")
