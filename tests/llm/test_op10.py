import random

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm.op10_embedding_lsh import _not_met, linked

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    good = [(v, np.array(e, float), g) for v, e, g in rows if e and g is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {v: 0 for v, _, _ in rows}
    up = {v: v for v, _, _ in rows}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, (a, x, g) in enumerate(good):
        for b, y, h in good[i + 1 :]:
            if g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {v: (links[v], root(v)) for v in links}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id) for r in linked(df, **more).collect()}


def planted():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(60):
        centre = rng.standard_normal(24)
        for _ in range(rng.integers(1, 9)):
            rows.append((n, (centre + rng.standard_normal(24) * rng.choice([0, 0.05, 0.2, 0.3])).astype(np.float32).tolist(), g % 3))
            n += 1
    return [(v, [float(np.float32(x)) for x in e], g) for v, e, g in rows]


def test_recall_on_planted_groups(spark):
    rows = planted()
    got, want = run(spark, rows), brute(rows)
    assert sum(x for x, _ in want.values()) > 300
    assert all(got[v][0] <= want[v][0] for v in want)  # no link below the threshold
    assert sum(x for x, _ in got.values()) >= 0.97 * sum(x for x, _ in want.values())


def test_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert run(spark, rows) == brute(rows)


def by_row(rows, cosine=0.93):
    """Sorted (vec_id, n_links, component_id) of rows in which a vec_id may repeat: links by row, components by vec_id."""
    fine = [e is not None and len(e) > 0 and g is not None and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e, g in rows]
    up = {v: v for v, _, _ in rows}
    links = [0] * len(rows)

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, (a, x, g) in enumerate(rows):
        for j, (b, y, h) in enumerate(rows[:i]):
            if fine[i] and fine[j] and g == h and len(x) == len(y):
                x_, y_ = np.array(x, float), np.array(y, float)
                if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    lo, hi = sorted((root(a), root(b)))
                    up[hi] = lo
    return sorted((v, n, root(v)) for (v, _, _), n in zip(rows, links, strict=True))


def test_repeated_ids_in_any_order(spark):
    rows = [(1, None, 1), (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.0, 1.0, 0.0], 1), (1, [0.0, 1.0, 0.01], 1), (4, [0.0] * 3, 1), (4, [0.0, 0.0, 1.0], 1)]
    rows += [(5, [0.0, 0.01, 1.0], 1), (0, [0.0, 0.01, 1.0], 1), (5, None, 1), (6, [-1.0, 0.0, 0.5], 1), (6, [-1.0, 0.0, 0.5], 1), (7, [1.0, 0.0, 0.0], None), (7, [-1.0, 0.0, 0.51], 1)]
    rnd = random.Random(4)
    want = by_row(rows)
    for _ in range(3):
        got = linked(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
        rnd.shuffle(rows)
    got = linked(spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in got) == [(0, 0, None), (0, 0, None), (3, 0, 3)]


def test_clusters_are_multiplied_once():
    """What a later table leaves out are pairs that met before, and no others."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        keys = rng.integers(0, 3, (12, 4))
        rest = set(_not_met(keys).tolist())
        for i in range(12):
            for j in range(i):
                assert i in rest or j in rest or (keys[i] == keys[j]).any()
    assert len(_not_met(np.ones((9, 2), int))) == 0 and len(_not_met(np.empty((9, 0), int))) == 9


def test_tight_clusters_long_vectors_and_ties(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.standard_normal(16) * 0.03], 1) for i in range(150)]
    far = rng.standard_normal(20_000)
    rows += [(200 + i, [float(np.float32(x)) for x in far + rng.standard_normal(20_000) * 0.01 * i], 1) for i in range(4)]
    rows += [(300, [1.0, 0.0], 1), (301, [0.75, 0.661437827766148], 2), (302, [1.0, 0.0], 2)]
    assert run(spark, rows, block=32) == run(spark, rows) == brute(rows)
    tie = [(1, [4.0, 0.0], 1), (2, [3.0, 4.0], 1)]  # a cosine of 0.6 exactly
    assert run(spark, tie, cosine=0.6, tables=256, projections=1, width=8.0) == {1: (1, 1), 2: (1, 1)}


def test_blocks_give_the_same(spark):
    rows = [(i, [1.0, 0.001 * (i % 40), 0.5], 1) for i in range(80)]
    assert run(spark, rows, block=16) == run(spark, rows) == brute(rows)


def test_nulls_zeros_and_repeats(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, None, 1), (3, [], 1), (4, [0.0] * 3, 1), (5, [1.0, None, 3.0], 1), (6, [1.0, float("nan"), 3.0], 1)]
    rows += [(7, [float("inf"), 2.0, 3.0], 1), (8, v, None), (9, [2.0, 4.0, 6.0], 1), (10, v, 2), (11, v + [0.0], 1), (12, v, 1)]
    want = {i: (0, i) for i in range(1, 13)} | {1: (2, 1), 9: (2, 1), 12: (2, 1)}
    assert run(spark, rows) == want


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], SCHEMA).withColumn("node", F.lit("x")).withColumn("key", F.lit(None)).withColumn("same", F.lit(3))
    assert sorted(tuple(r) for r in linked(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_a_vector_of_most_rows(spark):
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(16).astype(np.float32).tolist()
    rows = [(3 * i + 1, hot, 1) for i in range(300)] + [(3 * i, rng.standard_normal(16).astype(np.float32).tolist(), 1) for i in range(60)] + [(2, None, 1), (5, hot, None), (1, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in linked(df.repartition(9)).collect())
    assert [g for g in got if g[0] % 3 == 1] == sorted([(3 * i + 1, 299, 1) for i in range(300)] + [(1, 0, 1)])
    assert (2, 0, 2) in got and (5, 0, 5) in got and len(got) == len(rows)
