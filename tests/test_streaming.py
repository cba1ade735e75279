
from kinfold.operators.blocking import Blocking
from kinfold.plans import linkage
from kinfold.sources.tables import records, truth
from kinfold.streaming.incremental import latest, match_stream

DATA = "/root/testdata/sf0.001"


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    cfg = Blocking(most_candidates=20)
    rows = records(spark, DATA)
    got = linkage.train(rows, truth(spark, DATA), cfg, trees=2, share=0.3)
    one = rows.where("source = 1")
    cfg = Blocking(most_candidates=20, cap=12, number_cap=8)  # caps that the second batch goes over
    _, want = linkage.predict(rows, got.model, 0.2, cfg)
    want = sorted(map(tuple, want.collect()))
    for parts in (1, 3):
        one.repartition(parts, "entity_id").write.parquet(f"{tmp_path}/in{parts}")
        arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{parts}")
        match_stream(arriving, rows.where("source <> 1"), got.model, 0.2, f"{tmp_path}/out{parts}", f"{tmp_path}/state{parts}", cfg).awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out{parts}")
        assert out.select("batch").distinct().count() == parts
        assert sorted(map(tuple, latest(spark, f"{tmp_path}/out{parts}").select("source1_entity_id", "matched_entity_ids").collect())) == want
    assert out.count() > one.count()  # some entities were matched again
