import re

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm.op6_license_scan import BASE, BSD_CONDITIONS, MIT_GRANT, TEMPLATES, Index, scanned, words

SCHEMA = "doc_id long, text string"


def base(text):
    """By definition: (n_words, n_base, first, last, labels)."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def run(spark, rows):
    return {r.doc_id: r for r in scanned(spark.createDataFrame(rows, SCHEMA)).collect()}


def check(rows, got):
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score > 0) == (r.labels != "") and 0 <= r.score <= 1


def test_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows)
    check(rows, got)
    assert {"mit", "apache", "gpl", "cc-by-nc"} <= {r.labels for r in got.values()}


def test_every_template_is_found_and_nothing_else(spark):
    noise = "the work of a software license is under the terms of this version and any person may use it "
    rows = [(i, noise * 3 + t.text.upper() + ". " + noise) for i, t in enumerate(TEMPLATES)]
    rows += [(100, noise * 20), (101, "mit license MIT-License mit_license"), (102, "cc by nc 4 1"), (103, "General Public\n\nLicense, mit license apache license"), (104, "hereby granted free permission is of charge")]
    got = run(spark, rows)
    check(rows, got)
    assert all(t.label in got[i].labels.split(",") for i, t in enumerate(TEMPLATES))
    assert got[100].labels == got[102].labels == got[104].labels == ""


def test_a_template_does_not_cross_texts(spark):
    rows = [(1, "licensed under cc by"), (2, "nc 4 0"), (3, "mit"), (4, "license")]
    assert {r.labels for r in run(spark, rows).values()} == {""}


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " ,. "), (4, "MIT license " * 5000)]
    got = run(spark, rows)
    check(rows, got)
    assert got[4].n_base == 5000 and got[4].last_word == 9998
    assert run(spark, []) == {}
    df = spark.createDataFrame([(None, "mit license"), (None, "mit license")], SCHEMA).withColumn("i", F.lit(1)).withColumn("n", F.lit("x"))
    assert [r.base_labels for r in scanned(df).collect()] == ["mit", "mit"]


def test_whole_paragraphs_and_edits(spark):
    rows = [(k, f"Copyright 2020 A. Holder. {t.text.upper()} int main() {{ }}") for k, t in enumerate(TEMPLATES)]
    rows.append((100, BSD_CONDITIONS.replace("binary", "object")))  # a key phrase is broken
    rows.append((101, MIT_GRANT.replace("sublicense", "relicense")))  # a word is not
    got = {r.doc_id: r for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(TEMPLATES):
        assert t.label in got[k].labels.split(",") and got[k].score == 1.0
    assert got[100].labels == "" and got[101].labels == "mit" and got[101].score > 0.9


def test_the_index_holds_the_rarest_words():
    index = Index(TEMPLATES, BASE)
    with_word = np.full(len(index.vocabulary), 50.0)
    rare = words("merge publish sublicense furnished portions substantial")
    with_word[[index.code[w] for w in rare]] = 1.0
    index.weigh(100, with_word, 6)
    k = next(i for i, t in enumerate(TEMPLATES) if t.text == MIT_GRANT)
    assert {index.vocabulary[index.bodies[k][q]] for q in index.rare[k]} == set(rare)
