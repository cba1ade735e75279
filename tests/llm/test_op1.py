import random

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm.op1_token_packing import CONTEXT, PADDING, PATTERN, VOCABULARY, Rooms, best_fit_decreasing, cut, packed, ranks, unpacked_pieces

SCHEMA = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sStrevlmd  \n\t \u0085é٣1,.!中\U0001f600"), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    words, begin = cut(pa.array(texts, pa.string()))
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)] == [regex.findall(PATTERN, t) for t in texts]


def simple_best_fit(lengths, most):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rows if most - sum(lengths[j] for j in r) >= lengths[i]]
        if fits:
            max(fits, key=lambda r: sum(lengths[j] for j in r)).append(i)
        else:
            rows.append([i])
    return rows


def test_best_fit_decreasing_against_a_scan():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = [rnd.choice([0, 1, 50, rnd.randrange(101), 100]) for _ in range(rnd.randrange(60))]
        rows = best_fit_decreasing(np.array(lengths, int), 100)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        fill = lambda rs: sorted(sum(lengths[i] for i in r) for r in rs)
        assert fill(rows) == fill(simple_best_fit(lengths, 100)) and max(fill(rows), default=0) <= 100


def test_rooms_gives_the_least_that_fits():
    rnd, rooms, have = random.Random(4), Rooms(37), []
    for k in range(2000):
        if rnd.random() < 0.5:
            room = rnd.randrange(38)
            rooms.add(room, k)
            have.append(room)
        else:
            need = rnd.randrange(38)
            got, fits = rooms.take(need), [r for r in have if r >= need]
            assert (got[1] if got else None) == min(fits, default=None)
            if got:
                have.remove(got[1])


def read(rows, context=CONTEXT):
    """Each document's ids (one list a copy), put together from the pieces."""
    parts = {}
    for r in rows:
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= context
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert (ids[r.n_tokens :] == PADDING).all()
        for a, b in zip(r.cu_seqlens, [*r.cu_seqlens[1:-1], r.n_tokens], strict=False):
            assert (positions[a:b] == np.arange(b - a)).all()
        for doc, at, own in unpacked_pieces(r, context):
            parts.setdefault(doc, []).append((at, own.tolist()))
    return {d: sorted(p) for d, p in parts.items()}


def encoded(text):
    own = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks(VOCABULARY), special_tokens={})
    return own, own.encode_ordinary(text or "")


def test_round_trip_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = packed(df).collect()
    got = read(out)
    own, _ = encoded("")
    total = 0
    for r in df.collect():
        ids = [i for _, p in got[r.doc_id] for i in p]
        assert ids == own.encode_ordinary(r.text) and own.decode(ids) == r.text
        total += len(ids)
    assert len({r.pack_id for r in out}) == len(out) <= total / CONTEXT * 1.05 + df.rdd.getNumPartitions()


def test_splits_nulls_and_repeats(spark):
    long = "word " * 5000
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, "a"), (5, "a"), (None, "b"), (6, "<|endoftext|> it's")]
    got = read(packed(spark.createDataFrame(rows, SCHEMA).repartition(1), lot=3000).collect())
    assert got[1] == got[2] == [(0, [])]
    assert [i for _, p in got[3] for i in p] == [i for _, p in got[4] for i in p] == encoded(long)[1]
    assert [a for a, _ in got[3]] == [0, 2048, 4096]
    assert got[5] == [(0, encoded("a")[1])] * 2 and got[None] == [(0, encoded("b")[1])]
    assert got[6] == [(0, encoded(rows[-1][1])[1])]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packed(df).collect() == []
    df = spark.createDataFrame([(1, "x")], SCHEMA).withColumn("ids", F.lit("q")).withColumn("pack_id", F.lit(None))
    assert packed(df).collect()[0].doc_ids == [1]


def test_a_very_long_text(spark):
    text = "word and another one, " * 20_000
    got = read(packed(spark.createDataFrame([(1, text), (2, "short")], SCHEMA)).collect())
    assert [i for _, p in got[1] for i in p] == encoded(text)[1] and got[2] == [(0, encoded("short")[1])]
