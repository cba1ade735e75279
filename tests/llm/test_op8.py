import zlib

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm.op8_language_id import UNKNOWN, Lattice, even, expected, fit, identified, likeliest

DATA = "/root/testdata/sf0.01"


def all_cuts(word, p, k):
    """The sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    return sum(((p[word[:n]][k] if word[:n] in p else 0.0) + (UNKNOWN if n == 1 else 0.0)) * all_cuts(word[n:], p, k) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    known = sorted({"a", "b", "ab", "aba", "ba", "é", "bé", "xyz"})
    rng = np.random.default_rng(1)
    p = np.vstack([rng.random((len(known), 3)), np.zeros((1, 3))])
    table = {w: p[i] for i, w in enumerate(known)}
    for word in ("a", "abab", "ababéab", "q", "qxyzq", "abaabaabab"):
        got = Lattice(known).forward([word, word[::-1]], len(word), p)[0]
        for row, w in enumerate((word, word[::-1])):
            assert np.allclose(got[row], [np.log(all_cuts(w, table, k)) for k in range(3)])


def cuts(word):
    """All segmentations of a word."""
    return [[word[:n], *rest] for n in range(1, len(word) + 1) for rest in cuts(word[n:])] if word else [[]]


def test_expectation_against_all_segmentations():
    known = sorted({"a", "b", "ab", "aba", "ba", "bab", "c"})
    rng = np.random.default_rng(3)
    p = np.vstack([rng.random((len(known), 2)), np.zeros((1, 2))])
    words, counts = ["abab", "ba", "abcab", "qa", "babab", "c"], rng.integers(0, 5, (6, 2)).astype(float)
    want = np.zeros((len(known) + 1, 2))
    for w, own in zip(words, counts, strict=True):
        for k in range(2):
            value = lambda piece, k=k: (p[known.index(piece), k] if piece in known else 0.0) + (UNKNOWN if len(piece) == 1 else 0.0)
            odds = [(np.prod([value(x) for x in cut]), cut) for cut in cuts(w)]
            for odd, cut in odds:
                for x in cut:
                    if odd > 0:
                        want[known.index(x) if x in known else len(known), k] += own[k] * odd / sum(o for o, _ in odds)
    assert np.allclose(expected(Lattice(known), words, counts, p), want)


def test_fit_in_the_cluster_is_that_of_one_place(spark):
    known = sorted({"a", "b", "ab", "ba", "c", "abc"})
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)]
    words = sorted(set(words))
    counts = rng.integers(0, 4, (len(words), 3)).astype(float)
    rows = [(w, [k for k in range(3) if c[k]], [int(x) for x in c if x]) for w, c in zip(words, counts, strict=True)]
    df = spark.createDataFrame(rows, "word string, langs array<int>, n array<long>").repartition(5)
    p = even(len(known), 3)
    for _ in range(3):
        p = likeliest(expected(Lattice(known), words, counts, p))
    assert np.allclose(fit(df, known, 3, 3), p) and np.allclose(p[:-1].sum(axis=0), 1) and (p[-1] == 0).all()


def test_many_languages_and_one_huge_text(spark):
    rng = np.random.default_rng(5)
    rows = [(40 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}ora{chr(97 + j % 7)}" for j in rng.integers(0, 9, 30)), f"l{k:03}") for k in range(60) for i in range(4)]
    rows.append((10**6, "zzora zzela " * 100_000, "huge"))
    out = {r.doc_id: r.lang_pred for r in identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([out[d] == lang for d, _, lang in rows]) > 0.9


def test_long_words_neither_vanish_nor_overflow():
    got = Lattice(["a", "aa"]).forward(["a" * 5000, "q" * 5000], 5000, np.array([[0.5], [0.1], [0.0]]))[0]
    assert np.isfinite(got).all() and got[0] > got[1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = identified(docs, fit_documents=100).toPandas()
    want = docs.select("doc_id", "lang").toPandas()
    both = out.merge(want, on="doc_id")
    assert len(out) == len(want) and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(out.doc_id, out.held_out, strict=True))
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_und_nulls_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 -- 3", "en"), (4, "the end of the text", "en"), (5, "le texte de la fin", "fr"), (None, "the", "fr"), (None, "the", None)], "doc_id long, text string, lang string")
    docs = docs.withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("share", F.lit(None))
    got = [(r.doc_id, r.lang_pred) for r in identified(docs).collect()]
    assert got[:2] == [(1, "und"), (2, "und")] and all(x in ("en", "fr") for _, x in got[2:])
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in identified(nothing).collect()} == {("und", 0.0)}
    assert identified(docs.limit(0)).collect() == []
