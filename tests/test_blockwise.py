import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold import catalog
from kinfold.operators import blocking, blockwise, features, pairs
from kinfold.plans import linkage, models
from kinfold.runtime import keep

NAMES = ["Eye Care LLC", "Eye Care", "", "कमल eye", "Care Eye Inc", "LLC", "a", "x" * 70 + " y", "Thénard & Cie", "Thenard and Cie", "Eye Care Group", "Rd 12 12", "quote\" back\\\\slash \\u0001 \\t tab"]
PLACES = ["12 MG Rd., Opp. SBI, Pune", "", "12 12 mg road", "77", "77 12 Pune", "rue Ch. 5 bis"]


def _odd(spark):
    rows = [(1 + i % 3, f"S{1 + i % 3}-{i}", NAMES[i % len(NAMES)], PLACES[i % len(PLACES)], "en") for i in range(90)]
    rows.append((1, "S1-0", "Another Eye", "5", "en"))  # a repeated id
    norm = keep(blocking.normalised(spark.createDataFrame(rows, "source int, entity_id string, business_name string, business_address string, country string")), "norm")
    a, b = norm.where("source = 1").select("entity_id").distinct(), norm.where("source <> 1").select(F.col("entity_id").alias("candidate_id"))
    pairs = a.crossJoin(b).unionByName(spark.createDataFrame([("S1-none", "S2-1"), ("S1-0", "S2-none"), (None, "S2-1")], "entity_id string, candidate_id string"))
    number = F.xxhash64("entity_id", "candidate_id")
    score = F.when(number % 3 == 0, number % 7 / F.lit(7.0)).when(number % 3 == 1, F.lit(float("nan")))
    pairs = pairs.select("*", F.lit("name_ngram,name_token").alias("match_keys"), F.lit(2).alias("n_keys"), (number % 2 == 0).cast("int").alias("label"), score.alias("embedding_score"))
    return keep(pairs, "pairs"), norm


@pytest.mark.parametrize("wanted", [features.ALL, features.PRE_RANK, ("n_keys", "name_token_jaccard"), ("matched_by_token",)])
@pytest.mark.parametrize("block", [8, 4096])
def test_blocks_say_what_the_joins_say(spark, wanted, block):
    pairs, norm = _odd(spark)
    want, got = features.features(pairs, norm, wanted), blockwise.features(pairs, norm, wanted, block)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("cfg", [blocking.Blocking(), blocking.Blocking(cap=9, number_cap=3)])
@pytest.mark.parametrize("block", [8, 4096])
def test_pairs_found_in_cells_are_the_candidates(spark, cfg, block, monkeypatch):
    _, norm = _odd(spark)
    norm = keep(norm.withColumn("country", F.when(F.xxhash64("entity_id") % 5 == 0, None).when(F.xxhash64("entity_id") % 5 == 1, "fr").otherwise("en")), "norm")
    want, got = features.features(blocking.candidates(norm, cfg), norm), blockwise.candidate_features(norm, cfg, block=block)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    rows = sorted(map(repr, want.collect()))
    assert rows and sorted(map(repr, got.collect())) == rows


def test_large_tables_of_members_are_searched(monkeypatch):
    side = lambda prefix, sets: pa.table({"id": [f"{prefix}{i}" for i in range(len(sets))], "forms": [json.dumps({"name_tokens": s}) for s in sets]})
    a, b = [["x", "y"], [], ["z"]], [["y", "x", "q"], ["z"], []]
    x, y = (i.ravel() for i in np.meshgrid(range(3), range(3), indexing="ij"))
    for most in (1 << 26, 0):
        monkeypatch.setattr(blockwise, "TABLE", most)
        monkeypatch.setattr(blockwise, "STEP", 1 if most else 1 << 20)
        shared, both = blockwise._Cell(side("a", a), side("b", b), ["name_tokens"]).shared("name_tokens", x, y)
        assert shared.tolist() == [len({*p} & {*q}) for p in a for q in b] and both.tolist() == [len({*p} | {*q}) for p in a for q in b]


def test_no_join_carries_the_forms_of_each_pair(spark):
    """The wide queries' plans: a record's forms are joined to the cells it goes to, not to its pairs."""
    for name in ("pair_features_wide", "weighted_rankings_native_wide", "pre_rank_features_wide"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan, name


def test_a_sample_drawn_in_cells_is_that_of_all_pairs(spark):
    _, norm = _odd(spark)
    cfg = blocking.Blocking(cap=20)
    every = blocking.candidates(norm, cfg)
    true = keep(every.where(F.xxhash64("candidate_id", "entity_id") % 20 == 0).select("entity_id", "candidate_id"), "true")
    rows, found = linkage._found(norm, true.unionByName(spark.createDataFrame([("S1-0", "S2-none")], true.schema)), cfg)
    labels = pairs.labelled(every, true)
    assert sorted(map(repr, found.select(*labels.columns).collect())) == sorted(map(repr, labels.where("label = 1").collect()))
    entities = norm.where("source = 1 AND entity_id <> 'S1-3'").select("entity_id").distinct()
    for per_positive, block in ((2, 8), (6, 4096)):
        want = pairs.sampled(labels.join(entities, "entity_id", "left_semi"), per_positive, per_positive)
        most = found.groupBy("entity_id").agg((F.count(F.lit(1)) * (per_positive + 1)).alias("most"))
        first = blockwise.drawn(norm, rows, most, per_positive, block=block, only=entities)
        got = pairs.sampled(pairs.labelled(blocking.rendered(first).unionByName(found.drop("label")).distinct(), true).join(entities, "entity_id", "left_semi"), per_positive, per_positive)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and first.count() < every.count()
    want = pairs.sampled(labels.join(entities, "entity_id", "left_semi"))
    assert sorted(map(repr, linkage._sampled(norm, rows, found, entities, 42).select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_pairs_of_some_entities(spark):
    _, norm = _odd(spark)
    only = norm.where("source = 1 AND xxhash64(entity_id) % 3 = 0").select("entity_id")
    want = blockwise.candidate_features(norm, blocking.Blocking(), features.PRE_RANK).join(only, "entity_id", "left_semi")
    got = blockwise.candidate_features(norm, blocking.Blocking(), features.PRE_RANK, only=only)
    rows = sorted(map(repr, want.collect()))
    assert rows and sorted(map(repr, got.collect())) == rows


def test_pre_rankers_make_no_table_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocking, "key_pairs", None)
    for name in ("learned_pre_ranker", "pre_ranker_by_country"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name


@pytest.mark.parametrize("columns", [features.PRE_RANK, features.ALL])
def test_the_best_of_the_cells_are_the_best_of_all(spark, columns, monkeypatch):
    _, norm = _odd(spark)
    norm, cfg = keep(norm.where("name_clean <> 'another eye'"), "norm"), blocking.Blocking()
    every = keep(features.features(blocking.candidates(norm, cfg), norm), "every")
    model = models.fit(every.withColumn("label", (F.xxhash64("candidate_id") % 4 + 2 * F.col("n_keys") > 5).cast("int")), columns, trees=4, depth=3)
    scored = models.score(model, every, columns, "pre_rank_score")
    rows = blocking.capped(blocking.postings(norm, cfg), cfg)
    for strip, block in ((1, 8), (3, 8), (4, 4096)):
        monkeypatch.setattr(blockwise, "STRIP", strip)
        monkeypatch.setattr(blockwise, "STEP", 50 if strip == 3 else 1 << 20)
        got = linkage.reranked(blocking.rendered(blockwise.best(norm, rows, models.forest(model, columns), 5, block)), 5)
        side = lambda d: sorted((r.entity_id, r.candidate_id, r.n_keys, round(r.pre_rank_score, 9)) for r in d.collect())
        assert side(got) == side(linkage.reranked(scored, 5)) and got.count() > 50


def test_two_stages_make_no_table_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocking, "key_pairs", None)
    assert catalog.QUERIES["two_stage_light"](spark, "/root/testdata/sf0.001").count() == 19


def test_weighted_rankings_carry_no_forms_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(features, "features", None)
    assert catalog.QUERIES["weighted_rankings"](spark, "/root/testdata/sf0.001").select("ranking").distinct().count() == len(features.HAND_WEIGHTS)


@pytest.mark.parametrize("block", [8, 4096])
def test_sums_made_in_cells_are_those_of_the_features(spark, block):
    _, norm = _odd(spark)
    cfg = blocking.Blocking(cap=20)
    used = tuple(c for c in features.ALL if c != "embedding_score")
    rankings = {**features.HAND_WEIGHTS, "every feature": {c: 1.0 + i for i, c in enumerate(used)}, "less": {"name_char_jaccard": -3.0, "n_keys": 1.0}, "none": {}}
    rows = features.features(blocking.candidates(norm, cfg), norm, used)
    rows = rows.select("entity_id", "candidate_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes[2:]])
    for name, weights in rankings.items():
        rows = features.weighted(rows, weights, name)
    want = rows.select("entity_id", "candidate_id", *[F.round(f"`{n}`", 6).alias(n) for n in rankings])
    got = blockwise.candidate_scores(norm, cfg, rankings, block)
    assert got.dtypes == want.dtypes
    every = sorted(map(repr, want.collect()))
    assert every and sorted(map(repr, got.collect())) == every


def test_six_digits_round_halves_up(spark):
    q = [(p, n) for n in (1, 3, 7, 128, 640, 1920, 3200, 3 * 128, 78125 * 2) for p in range(min(n, 2000) + 1)]
    want = [r.x for r in spark.createDataFrame(q, "p int, n int").select(F.round(F.col("p") / F.col("n"), 6).alias("x")).collect()]
    assert blockwise.six_digits(np.array([p / n for p, n in q])).tolist() == want
    assert blockwise.six_digits(np.array([-p / n for p, n in q])).tolist() == [-x for x in want]


def test_only_weighted_sums_leave_the_cells(spark, monkeypatch):
    """No feature of a pair is handed on, only its sums; no row is rounded or summed outside."""
    monkeypatch.setattr(features, "weighted", None)
    rows = catalog.QUERIES["weighted_rankings_native_wide"](spark, "/root/testdata/sf0.001")
    made = rows._jdf.queryExecution().optimizedPlan()
    assert made.getClass().getSimpleName() == "MapInArrow" and made.output().size() == 2 + len(features.HAND_WEIGHTS)


def test_large_cells_are_compared_in_parts_and_records_go_to_fewer(spark, monkeypatch):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("source"))
    monkeypatch.setattr(blockwise, "MOST_BLOCK", 4096)
    n = blockwise._blocks(rows, None)
    assert n == (5, 10) and blockwise._blocks(rows, None, rows.limit(3)) == (1, 20) and blockwise._blocks(rows, 2048) == (10, 20)
    table = lambda ids: pa.table({"id": ids}).to_batches()
    monkeypatch.setattr(blockwise, "BLOCK", 4)
    sizes = lambda ids: [sum(map(len, b)) for _, (_, b) in blockwise._parts(0, (table(["x"]), table(ids)))]
    assert sizes(list("abcdefghij")) == [4, 4, 2] and sizes(list("abcdefghia")) == [10]
    _, norm = _odd(spark)
    assert sorted(map(repr, blockwise.candidate_features(norm, blocking.Blocking()).collect())) == sorted(map(repr, features.features(blocking.candidates(norm), norm).collect()))


@pytest.mark.parametrize("kind", ["weights", "forests"])
def test_ranks_counted_in_cells_are_those_of_all_candidates(spark, kind, monkeypatch):
    _, norm = _odd(spark)
    cfg = blocking.Blocking(cap=20)
    columns = features.PRE_RANK if kind == "forests" else tuple(dict.fromkeys(c for w in features.HAND_WEIGHTS.values() for c in w))
    if kind == "forests":
        norm = keep(norm.where("name_clean <> 'another eye'"), "norm")
    every = keep(blocking.candidates(norm, cfg), "every")
    rows = keep(blocking.capped(blocking.postings(norm, cfg), cfg), "rows")
    values = keep(features.features(every, norm, columns), "values")
    if kind == "forests":
        label = (F.xxhash64("candidate_id") % 4 + 2 * F.col("n_keys") > 5).cast("int")
        found = [models.fit(values.withColumn("label", x), columns, trees=4, depth=3) for x in (label, 1 - label)]
        rankings, names = blockwise.Forests([models.forest(m, columns) for m in found]), ["x", "y"]
        scored = [models.score(m, values, columns).select("entity_id", "candidate_id", "n_keys", F.round("score", 9).alias("score")) for m in found]
    else:
        rankings, names = blockwise.Weights(list(features.HAND_WEIGHTS.values())), list(features.HAND_WEIGHTS)
        rounded = values.select("entity_id", "candidate_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in values.dtypes[2:]])
        scored = [features.weighted(rounded, features.HAND_WEIGHTS[n], "v").select("entity_id", "candidate_id", F.lit(0).alias("n_keys"), F.round("v", 6).alias("score")) for n in names]
    true = F.xxhash64("candidate_id", "entity_id") % 9 == 0
    want = []
    for k, one in enumerate(scored):
        want += [(k, r.entity_id, r.candidate_id, r.rank) for r in blocking.ranked(one, F.desc("score"), F.desc("n_keys")).where(true).collect()]
    each = values.where(true).withColumn("ranking", F.explode(F.array(*map(F.lit, range(len(names))))))
    marked = keep(blockwise.marks(each, rankings), "marks")
    for block, step in ((8, 40), (4096, 1 << 20)):
        monkeypatch.setattr(blockwise, "STEP", step)
        got = [(r.ranking, r.entity_id, r.candidate_id, r.rank) for r in blockwise.ranks(norm, rows, marked, rankings, len(names), block).collect()]
        first = {x[:3]: min(y[3] for y in got if y[:3] == x[:3]) for x in got}  # a repeated id's rows tie
        for x in want:
            assert x[:3] in first
        assert len(got) == len(want) > 50
        if kind == "forests":
            assert sorted(got) == sorted(want)
        else:
            own = lambda t: sorted(x for x in t if x[1] != "S1-0")
            assert own(got) == own(want)


def test_recall_queries_hand_on_no_candidates(spark, monkeypatch):
    """Neither candidates nor their features are made as rows, whatever their number: only counts leave the cells."""
    monkeypatch.setattr(blocking, "key_pairs", None)
    monkeypatch.setattr(blockwise, "candidate_features", None)
    monkeypatch.setattr(blocking, "ranked", None)
    for name in ("weighted_rankings", "learned_pre_ranker"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name


def test_a_task_draws_from_all_its_cells_at_once(spark, monkeypatch):
    _, norm = _odd(spark)
    norm = keep(norm.where("name_clean <> 'another eye'"), "norm")
    rows = keep(blocking.capped(blocking.postings(norm, blocking.Blocking())), "rows")
    none = spark.createDataFrame([], "entity_id string, most long")
    monkeypatch.setattr(blockwise, "BLOCK", 4)
    monkeypatch.setattr(blockwise, "STEP", 60)
    got = blockwise.drawn(norm, rows, none, 2, block=4096).groupBy("entity_id").count().collect()
    assert got and max(r["count"] for r in got) <= 2
