import re
from collections import Counter

from pyspark.sql import functions as F

from kinfold.llm.op5_source_mix import _power, mixed, plan, shuffled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def want_targets(sizes):
    """By the rule: weights 5, 2, 1 in order of the source, null last; excess over twice the size reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check(rows, out):
    text = Counter((r[0], len(words(r[1])), r[3]) for r in rows)
    assert Counter((r.doc.doc_id, r["size"], r.doc.source) for r in out) == text
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = want_targets(sizes)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.doc.source]
        assert abs(r.target - target[r.doc.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r["size"] * len(r.whole) + (r.rest or 0)
        taken[r.doc.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in df.collect()]
    out = mixed(df).collect()
    check(rows, out)
    again = mixed(df.repartition(5)).collect()
    key = lambda rs: sorted((r.doc.doc_id, r.taken, tuple(r.whole), r.rest, r.rest_shard) for r in rs)
    assert key(out) == key(again)


def test_shards_get_equal_numbers_of_blocks_and_each_block_once_a_copy(spark):
    table = plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), levels=3).collect()
    shards = Counter(s for r in table for s in r.whole) + Counter(r.rest_shard for r in table if r.rest is not None)
    assert len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1
    assert all(len(r.whole) + (r.rest is not None) <= 2 for r in table)
    assert all(sum(r.rest is not None for r in table if r.key == k) <= 1 for k in {r.key for r in table})


def test_the_mix_has_the_words_taken(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc.doc_id: r.taken for r in mixed(df).collect()}
    out = shuffled(df)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert all(got[d] == t for d, t in want.items())


def test_nulls_repeats_and_odd_sources(spark):
    rows = [(i, "w " * (i % 7), "en", s, i) for i, s in enumerate(["b", None, "", "ä", "a"] * 8)]
    rows += [(3, "x y z", "en", "b", 1)] * 3 + [(None, "q q", None, None, None), (50, None, "en", "empty", 0), (51, " \n", "en", "empty", 0)]
    check(rows, mixed(spark.createDataFrame(rows, SCHEMA)).collect())


def test_empty_table_and_clashing_columns(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    for c in ("key", "block", "size", "doc", "target", "rest"):
        df = df.withColumn(c, F.lit("x"))
    assert [r.taken for r in mixed(df).collect()] == [3]
    assert shuffled(df).columns == df.columns


def test_equal_rows_and_a_very_long_text_in_a_cut_block(spark):
    rows = [(1, "w " * 7, "a")] * 40 + [(2, "x " * 50_000, "b")] + [(3 + i, "y " * 3, "b") for i in range(20)]
    for blocks in (1, 4):  # one block is cut for sure
        out = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=blocks, levels=2).collect()
        for source in "ab":
            own = [r for r in out if r.doc.source == source]
            assert sum(r.taken for r in own) == round(own[0].target) and all(0 <= r.taken <= 2 * r.size for r in own)


def test_blocks_and_shards_follow_the_documents():
    assert [_power(n, 4096, 256, 1 << 14) for n in (0, 10**6, 10**7, 10**10)] == [256, 256, 4096, 1 << 14]
    assert [_power(n, 1 << 16, 32, 1 << 14) for n in (1, 1 << 21, (1 << 21) + 1, 10**9)] == [32, 32, 64, 1 << 14]
