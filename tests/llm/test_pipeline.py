from collections import Counter

import corpus_pipeline
import test_op1
import test_op2
import test_op3
from pyspark.sql import functions as F

from kinfold.llm import op4_quality_qda, op5_source_mix

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mix", "packed_ids"]

    good = {r.doc_id for r in op4_quality_qda.scored(docs, labels).collect() if r.predicted}
    one = stages["quality"](spark, docs, DATA).cache()
    assert {r.doc_id for r in one.collect()} == good and 0 < len(good) < docs.count() and one.columns == columns

    classes = test_op3.brute([(r.doc_id, r.text) for r in one.collect()])
    two = stages["near_duplicates"](spark, one, DATA).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(classes.values())) and two.columns == columns

    texts = [(r.doc_id, r.text) for r in two.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    leaked = {d for d, _ in test_op2.standing(texts, items)}
    three = stages["decontamination"](spark, two, DATA).cache()
    assert {r.doc_id for r in three.collect()} == {d for d, _ in texts} - leaked and three.columns == columns

    taken = {r.doc.doc_id: r.taken for r in op5_source_mix.mixed(three).collect()}
    four = stages["mix"](spark, three, DATA).cache()
    got = Counter()
    for r in four.collect():
        got[r.doc_id] += len((r.text or "").encode().split())
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if n} and four.columns == columns

    ids = test_op1.read(stages["packed_ids"](spark, four, DATA).collect())
    assert set(ids) == {r.doc_id for r in four.collect()}


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some text of no id at all", "en", "s", 1), (3, "", "en", None, 0), (3, "", "en", None, 0)], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(60).unionByName(odd).withColumn("key", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_rows_of_null_and_repeated_ids_are_judged_each(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    item = next(t for t in (r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()) if t and len(t.split()) >= 20)
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    texts = [(None, f"{one} {item} {two}"), (None, one), (7, f"{three} {item} {one}"), (7, two), (8, two), (9, three), (3, three), (7, three + " more")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select([F.col(f.name).cast(f.dataType) for f in schema]).withColumn("Row", F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["decontamination"](spark, docs, DATA)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(t for t in texts if item not in t[1])

    first = stages["near_duplicates"](spark, docs, DATA)
    assert first.columns == docs.columns
    want = [texts[0], texts[1], texts[2], (7, two), (3, three)]  # no doc_id: stay; of two's and three's rows that of the smallest
    assert Counter((r.doc_id, r.text) for r in first.collect()) == Counter(want)
