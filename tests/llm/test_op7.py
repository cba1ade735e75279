import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinfold.llm.op7_substring_dedup import _bucket, _merged, removed

SCHEMA = "doc_id long, text string"
DATA = "/root/testdata/sf0.001"


def brute(rows, width=20):
    """By definition: (doc_id, n_words, n_removed, kept) of each row; earlier is a smaller (doc_id, start)."""
    first, words = {}, []
    for doc, text in rows:
        w = (text or "").encode().split()
        words.append((doc, w))
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, (doc, s)), (doc, s))
    out = []
    for doc, w in words:
        dead = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (doc, s):
                dead.update(range(s, s + width))
        out.append((doc, len(w), len(dead), b" ".join(x for i, x in enumerate(w) if i not in dead).decode()))
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in removed(spark.createDataFrame(rows, SCHEMA)).collect())


def test_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_shifted_repeats_and_lengths(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(10 + k, " ".join([f"x{k}_{i}" for i in range(k)] + base[k * 7 : k * 7 + 19 + k % 3] + ["end"])) for k in range(1, 30)]
    rows += [(1, " ".join(base)), (2, "the " * 50), (3, " ".join(base[50:69])), (4, " ".join(base[50:70]))]
    assert run(spark, rows) == brute(rows)


def test_nulls_empty_and_repeated_rows(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n"), (5, text), (5, text), (6, "b " + text), (-4, text + " tail x")]
    assert run(spark, rows) == brute(rows)


def test_null_ids_come_last(spark):
    text = " ".join(f"a{i}" for i in range(40))
    got = {r.doc_id: r.n_removed for r in removed(spark.createDataFrame([(None, text), (9, text)], SCHEMA)).collect()}
    assert got == {None: 40, 9: 0}


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "x " * 30)], SCHEMA).withColumn("grp", F.lit("q")).withColumn("bucket", F.lit(1)).withColumn("places", F.lit(None))
    assert removed(df).collect()[0].n_words == 30


def test_any_partitioning_gives_the_same(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    a = removed(df).toPandas().sort_values("doc_id", ignore_index=True)
    b = removed(df.repartition(7)).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_rows_with_null_ids_are_documents_of_their_own(spark):
    """Distinct texts without an id stand after all others, in some order; equal ones are one document."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, f"{one} x {two}"), (None, f"{two} y {one}"), (None, "c " * 5), (7, "d " * 5)]
    got = [(r.doc_id, r.n_removed) for r in removed(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(n for d, n in got if d is None) == [0, 0, 80] and (7, 0) in got


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words[1000:1100])), (2, " ".join(words)), (3, " ".join(words[200_000:200_030]) + " tail")]
    assert {r.doc_id: r.n_removed for r in removed(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 0, 2: 100, 3: 30}


def test_a_hash_sends_its_bucket_one_place_a_chunk():
    keys = np.full(1000, 12345 << 20, np.uint64)
    docs, places = np.arange(1000), np.zeros(1000, np.int64)
    order, known = _merged(keys, np.zeros(1000, "<u4"), docs, places)
    got = _bucket(keys[order], docs[order], known, 97)
    assert (known < 2).sum() == 1 and got[known < 2] == 12345 % 97
    assert np.bincount(got[known == 2], minlength=97).max() <= 11


def test_a_passage_of_most_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i} " + (passage if i % 5 == 0 else "")) for i in range(400)]
    assert run(spark, rows) == brute(rows)
