from pyspark.sql import functions as F

from kinfold.operators import blocking, pairs, vectors
from kinfold.operators.blocking import Blocking
from kinfold.plans import linkage
from kinfold.sources.noise import noisy_copies
from kinfold.sources.tables import records

DATA = "/root/testdata/sf0.01"


def test_noisy_copies_are_found_and_matched(spark):
    clean = records(spark, DATA).where("source = 1").dropDuplicates(["business_name"])
    copies, truth = noisy_copies(clean)
    n, alone = clean.count(), clean.join(truth, "entity_id", "left_anti").count()
    assert 0 < alone < 0.15 * n and n < truth.count() < 4 * n
    assert copies.where("business_address = ''").count() > 0
    every = clean.unionByName(copies).persist()
    cfg = Blocking(most_candidates=30)
    found = pairs.labelled(blocking.candidates(blocking.normalised(every), cfg), truth)
    assert pairs.recall(found, truth).first().pair_level_recall > 0.95
    got = linkage.train(every, truth, cfg, trees=10, share=0.3)
    assert got.macro_f_beta > 0.5
    again, _ = noisy_copies(clean.repartition(5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies.collect()))


def test_embedding_candidates_stay_within_a_country(spark):
    rows = spark.createDataFrame([("S1-1", 1, "US"), ("S2-1", 2, "US"), ("S2-2", 2, "FR"), ("S3-1", 3, "US")], "entity_id string, source int, country string")
    near = spark.createDataFrame([("S1-1", [1.0, 0.0]), ("S2-1", [0.9, 0.1]), ("S2-2", [1.0, 0.0]), ("S3-1", [0.0, 1.0])], "entity_id string, embedding array<float>")
    got = vectors.embedding_candidates(rows, near, 1).collect()
    assert [(r.entity_id, r.candidate_id) for r in got] == [("S1-1", "S2-1")]
    text = vectors.encoder_text(spark.createDataFrame([("S1-1", "a", "b")], "entity_id string, business_name string, business_address string"))
    assert text.select(F.col("text")).first().text == "a b"
