import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking, metric, outputs, pairs, vectors
from kinfold.operators.blocking import Blocking

PAIR = "entity_id string, candidate_id string"


def df(spark, rows, schema=PAIR):
    return spark.createDataFrame(rows, schema)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity_id string")


def scores(spark, entities, truth, predicted):
    out = metric.entity_scores(ids(spark, *entities), df(spark, truth), df(spark, predicted)).collect()
    return {r.entity_id: r.f_beta for r in out}


def test_f_beta_cases(spark):
    truth = [("a", "S2-00047"), ("a", "S3-00812"), ("d", "x"), ("d", "y"), ("e", "x"), ("e", "y")]
    predicted = [("a", "S2-00047"), ("a", "S2-00193"), ("a", "S3-00812"), ("c", "S2-1"), ("e", "x"), ("e", "y")]
    got = scores(spark, "abcde", truth, predicted)
    assert got["a"] == pytest.approx(0.714, abs=1e-3)
    assert (got["b"], got["c"], got["d"], got["e"]) == (1.0, 0.0, 0.0, 1.0)


def test_a_wrong_match_costs_more_than_a_missed_one(spark):
    truth = [(e, x) for e in "pq" for x in "wxyz"]
    got = scores(spark, "pq", truth, [("p", x) for x in "wxyzv"] + [("q", x) for x in "wxy"])
    assert got["p"] < got["q"]


def test_macro_counts_singletons_and_missing_rows(spark):
    one = metric.macro_f_beta(ids(spark, "S1-1", "S1-2"), df(spark, []), df(spark, [("S1-2", "S2-9")])).first()
    assert one.macro_f_beta == 0.5 and one.entities == 2
    assert metric.macro_f_beta(ids(spark, "S1-1"), df(spark, [("S1-1", "S2-1")]), df(spark, [])).first().macro_f_beta == 0.0
    assert metric.macro_f_beta(ids(spark), df(spark, []), df(spark, [])).first().macro_f_beta == 0.0


def test_curve_is_the_metric_at_each_threshold(spark):
    rng = np.random.default_rng(5)
    entities = [f"e{i}" for i in range(30)]
    truth = [(e, f"c{k}") for e in entities for k in range(4) if rng.random() < 0.3]
    rows = [(e, f"c{k}", float(rng.choice([0.05, 0.1, 0.35, 0.5, 0.55, 0.95, rng.random()]))) for e in entities for k in range(6) if rng.random() < 0.7]
    rows += [(e, c, s / 2) for e, c, s in rows[:10]]  # repeated pairs: the best score counts
    scored, e, t = df(spark, rows, PAIR + ", score double"), ids(spark, *entities), df(spark, truth)
    curve = {r.threshold: r.macro_f_beta for r in metric.threshold_curve(e, t, scored).collect()}
    assert sorted(curve) == list(metric.GRID)
    for x in (0.05, 0.1, 0.35, 0.5, 0.95):
        assert curve[x] == pytest.approx(metric.macro_f_beta(e, t, metric.predictions(scored, x)).first().macro_f_beta)
    best = metric.best_threshold(metric.threshold_curve(e, t, scored)).first()
    top = max(curve.values())
    assert best.threshold == min(x for x, v in curve.items() if v > top - 1e-9)


def test_lists_and_violations(spark):
    e = ids(spark, "S1-1", "S1-2", "S1-3")
    found = df(spark, [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S3-1"), ("S1-1", "S2-2")])
    scored = df(spark, [("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.3), ("S1-2", "S3-1", 0.9)], PAIR + ", score double")
    records = spark.createDataFrame([("S2-1", 2), ("S2-2", 2), ("S3-1", 3)], "entity_id string, source int")
    a, b = outputs.build(e, found, scored, records, 0.5)
    assert {tuple(r) for r in a.collect()} == {("S1-1", "S2-1,S2-2"), ("S1-2", "S3-1"), ("S1-3", "")}
    assert {tuple(r) for r in b.collect()} == {("S1-1", "S2-1"), ("S1-2", "S3-1"), ("S1-3", "")}
    assert outputs.match_rate(b).first().match_rate == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        outputs.build(e, found, df(spark, [("S1-1", "S2-999", 0.9)], PAIR + ", score double"), records, 0.5)
    with pytest.raises(ValueError):
        outputs.build(e, found, df(spark, [("S1-3", "S2-1", 0.9)], PAIR + ", score double"), records, 0.5)


def vec(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, embedding array<float>")


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    own = [(f"v{i:03d}", rng.standard_normal(64)) for i in range(200)]
    got = vectors.neighbours(vec(spark, own), vec(spark, own), 5, block=64).collect()
    best = {}
    for r in got:
        best.setdefault(r.entity_id, []).append((r.embedding_score, r.candidate_id))
    assert all(len(v) == 5 and max(v)[1] == e and max(v)[0] > 0.999 for e, v in best.items())
    x = np.stack([v for _, v in own]).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 7, 150):
        want = np.sort(np.round(x[i] @ x.T, 6))[::-1][:5]
        assert np.allclose(sorted((s for s, _ in best[f"v{i:03d}"]), reverse=True), want, atol=1e-6)
    target = rng.standard_normal(32)
    near = [("TARGET", target + 0.05 * rng.standard_normal(32))] + [(f"r{i}", rng.standard_normal(32)) for i in range(50)]
    first = vectors.neighbours(vec(spark, [("q", target)]), vec(spark, near), 3).orderBy(F.desc("embedding_score")).first()
    assert first.candidate_id == "TARGET"
    assert vectors.neighbours(vec(spark, own[:1]), vec(spark, own[:10]), 1000).count() == 10
    assert vectors.neighbours(vec(spark, own[:1]), vec(spark, []), 5).count() == 0


def test_merge_with_embedding_candidates(spark):
    keys = df(spark, [("a", "x", "name_token", 1), ("a", "y", "addr_number,name_token", 2)], PAIR + ", match_keys string, n_keys int")
    near = df(spark, [("a", "y", 0.9), ("b", "z", 0.8)], PAIR + ", embedding_score double")
    got = {(r.entity_id, r.candidate_id): (r.match_keys, r.n_keys, r.embedding_score) for r in vectors.merged(keys, near).collect()}
    assert got == {("a", "x"): ("name_token", 1, None), ("a", "y"): ("addr_number,name_token,embedding", 3, 0.9), ("b", "z"): ("embedding", 1, 0.8)}


RECORD = "source int, entity_id string, business_name string, business_address string, country string"


def test_caps_are_by_source_and_country(spark):
    rows = [(1, f"S1-{i}", "alpha", "", "US") for i in range(3)] + [(2, f"S2-{i}", "alpha", "", "US") for i in range(2)] + [(3, "S3-1", "alpha", "", "US"), (2, "S2-9", "alpha", "", "FR")]
    norm = blocking.normalised(df(spark, rows, RECORD), normalise=False)
    count = lambda cap: blocking.candidates(norm, Blocking(cap=cap, kinds=("name_token",))).count()
    assert count(3) == 9 and count(2) == 0 and count(400) == 9
    assert {r.n_keys for r in blocking.candidates(norm).collect()} == {3}
    top = blocking.top_candidates(blocking.candidates(norm), 2)
    assert {r.candidate_id for r in top.collect()} == {"S2-0", "S2-1"} and blocking.top_candidates(norm, None) is norm


def test_labels_recall_and_empty_denominators(spark):
    true = pairs.truth_pairs(df(spark, [("a", "x,y"), ("b", ""), ("c", "z")], "source1_entity_id string, matched_entity_ids string"))
    found = pairs.labelled(df(spark, [("a", "x", 1), ("a", "q", 2), ("c", "z", 1)], PAIR + ", n_keys int"), true)
    assert {(r.entity_id, r.candidate_id, r.label) for r in found.collect()} == {("a", "x", 1), ("a", "q", 0), ("c", "z", 1)}
    r = pairs.recall(found, true).first()
    assert (r.total_true_matches, r.matches_found_in_candidates, r.entities_with_matches, r.entities_fully_recalled) == (3, 2, 2, 1)
    none = pairs.recall(found, df(spark, [])).first()
    assert none.total_true_matches == 0 and none.pair_level_recall is None


def test_split_is_exact_and_the_same_in_any_order(spark):
    rows = spark.createDataFrame([(f"S1-{i}", "US" if i % 3 else "IN") for i in range(100)], "entity_id string, country string")
    out = pairs.split(rows).collect()
    assert sum(r.split == "val" for r in out if r.country == "IN") == math.floor(34 * 0.15) and len(out) == 100
    assert sorted(map(tuple, out)) == sorted(map(tuple, pairs.split(rows.repartition(7).unionByName(rows)).collect()))


def test_split_takes_the_least_hashes_of_each_group(spark):
    rows = [(f"e{i}", "IN" if i % 3 else "US") for i in range(400)] + [("x", None)]
    got = {(r.entity_id, r.country) for r in pairs.split(spark.createDataFrame(rows, "entity_id string, country string"), 0.3, 7).collect() if r.split == "val"}
    want = set()
    for c in ("IN", "US"):
        own = sorted((hashlib.md5(f"7|{e}".encode()).hexdigest(), e) for e, g in rows if g == c)
        want |= {(e, c) for _, e in own[: math.floor(len(own) * 0.3)]}
    assert got == want


def test_sampling_keeps_positives_and_weighs_negatives(spark):
    rows = [(f"e{e}", f"c{k}", 1 + k % 4, int(k < e % 3)) for e in range(300) for k in range(40)]
    out = pairs.sampled(df(spark, rows, PAIR + ", n_keys int, label int")).collect()
    for e in range(6):
        own = [r for r in out if r.entity_id == f"e{e}"]
        assert sum(r.label for r in own) == e % 3 and sum(1 - r.label for r in own) == 6 * max(1, e % 3)
    kept = [r.n_keys for r in out if not r.label]
    assert kept.count(4) > 1.5 * kept.count(1)


def test_aligned_sample_and_coverage(spark):
    rows = [(1, f"S1-{i}", "n", "", "US") for i in range(20)] + [(s, f"S{s}-{i}", "n", "", "US") for s in (2, 3) for i in range(30)]
    records = df(spark, rows, RECORD)
    true = df(spark, [(f"S1-{i}", f"S2-{i}") for i in range(20)])
    out = pairs.aligned_sample(records, true, 5, 7).collect()
    by = {x: {r.entity_id for r in out if r.role == x} for x in ("entity", "match", "distractor")}
    assert len(by["entity"]) == 5 and by["match"] == {e.replace("S1", "S2") for e in by["entity"]} and len(by["distractor"]) == 14
    with pytest.raises(ValueError):
        pairs.aligned_sample(records, df(spark, [(f"S1-{i}", "S2-999") for i in range(20)]), 5, 7)
    lost = pairs.coverage(records, df(spark, [("S1-1", "S2-1"), ("S1-1", "S3-99")])).collect()
    assert {(r.source, r.found, r.missing) for r in lost} == {(2, 1, 0), (3, 0, 1)}
