from pyspark.sql import functions as F

import __spark_entry__
from kinfold.operators.blocking import Blocking
from kinfold.plans import linkage, models
from kinfold.sources.tables import records, truth

DATA = "/root/testdata/sf0.01"


def test_train_and_predict(spark, tmp_path):
    cfg = Blocking(most_candidates=30, cap=100)
    rows = records(spark, DATA)
    true = truth(spark, DATA)
    got = linkage.train(rows, true, cfg, trees=5, share=0.3)
    assert got.macro_f_beta > 0.5 and len(got.curve) == 19
    got.save(spark, f"{tmp_path}/run", cfg)
    meta = linkage.load_meta(spark, f"{tmp_path}/run")
    assert meta["threshold"] == got.threshold and meta["blocking"]["cap"] == 100
    assert meta["train_rows"] > 0 and meta["trees"] == models.trees(got.model) and set(meta["recall_by_country"]) == {"de", "en", "es", "fr"}
    assert meta["train_entities"] + meta["validation_entities"] == rows.where("source = 1").count() and 0 < meta["recall"]["pair_level_recall"] <= 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/run/threshold_curve").count() == 19
    model = models.load(f"{tmp_path}/run/model")
    assert len(models.importances(model)) == len(meta["features"])
    found, matched = linkage.predict(rows, model, got.threshold, cfg)
    n = rows.where("source = 1").count()
    assert found.count() == matched.count() == n
    assert matched.where(F.col("matched_entity_ids") != "").count() > 0


def test_entry_and_names(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["entity_id", "candidate_id", "match_keys", "n_keys"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
