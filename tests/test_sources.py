import re

import pytest
from pyspark.sql import functions as F

from kinfold.sources import tables, tsv


def test_round_trip(spark, tmp_path):
    rows = [("S1-1", 'Foo "B" Inc', "", "US"), ("S1-2", "NA", "NULL", ""), ("S1-3", "", "a, b", "FR"), ("S1-4", "é ü", "x\\y", "IN")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in tsv.RECORD))
    tsv.write_tsv(df, f"{tmp_path}/out")
    assert sorted(map(tuple, tsv.read_tsv(spark, f"{tmp_path}/out").collect())) == sorted(rows)
    assert tsv.read_tsv(spark, f"{tmp_path}/out", wanted=("entity_id",)).columns == ["entity_id"]
    with pytest.raises(Exception, match="already exists"):
        tsv.write_tsv(df, f"{tmp_path}/out")


def test_reads_doubled_quotes_and_missing_fields(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Foo ""B"" Inc"\t\tUS\n', encoding="utf-8")
    assert tuple(tsv.read_tsv(spark, f"{tmp_path}/a.tsv").first()) == ("S1-1", 'Foo "B" Inc', "", "US")


def test_load_and_stages(spark, tmp_path):
    (tmp_path / "train").mkdir()
    for k in (1, 2, 3):
        (tmp_path / f"train/train_source{k}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS{k}-1\tn\ta\tUS\n")
    (tmp_path / "train/train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\n")
    records, truth = tsv.load_sources(spark, str(tmp_path))
    assert {(r.source, r.entity_id) for r in records.collect()} == {(k, f"S{k}-1") for k in (1, 2, 3)}
    assert truth.first().matched_entity_ids == "S2-1,S3-1"
    tsv.write_stage(records, f"{tmp_path}/stage", ("country",))
    with pytest.raises(Exception, match="already exists"):
        tsv.write_stage(records, f"{tmp_path}/stage")
    tsv.write_stage(records, f"{tmp_path}/stage", ("country",), clean=True)
    assert tsv.read_stage(spark, f"{tmp_path}/stage").count() == 3
    assert tsv.folder_name("") == "UNKNOWN" and tsv.folder_name("a/b c") == "a_b_c"
    assert [r.entity_id for r in tsv.first_rows(records, 2, "entity_id").collect()] == ["S1-1", "S2-1"]
    assert tsv.to_parquet(spark, f"{tmp_path}/train/train_source1.tsv", f"{tmp_path}/p").count() == 1


def test_longest_words_are_those_of_brute_force_and_no_expression_of_arrays(spark):
    texts = [None, "", "  12 ", "b aa aa Cc 1dd", "é \u0085b İIßſ 😀ab zz Zz zz", "a" * 20 + " " + "b" * 21 + "_" + "é" * 20 + "-" + "é" * 21, "x\ty\nz\x0bq\x00w ab　cd", "short and longest words, of one length: abcde abcdf"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", *[tables.longest_words(F.col("text"), n).alias(f"n{n}") for n in (1, 3, 12)])
    for r in rows.collect():
        words = sorted({w for w in re.findall(tables.WORD, texts[r.i] or "") if len(w) <= tables.LONGEST_WORD}, key=lambda w: (-len(w), w))
        assert (r.n1, r.n3, r.n12) == tuple(" ".join(words[:n]) for n in (1, 3, 12)), texts[r.i]
    for made in (tables.records(spark, "/root/testdata/sf0.001"), tables.truth(spark, "/root/testdata/sf0.001")):
        assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
