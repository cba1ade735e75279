import inspect

import duckdb
import pytest

from kinfold import catalog
from kinfold.operators import blocking, features
from kinfold.operators.blocking import Blocking
from kinfold.plans import linkage
from kinfold.sources.tables import records

DATA = "/root/testdata/sf0.001"


def _pairs(rows):
    return {(r.entity_id, r.candidate_id) for r in rows.select("entity_id", "candidate_id").collect()}


def test_features_and_rankings_run_on_the_production_caps(spark):
    norm = blocking.normalised(records(spark, DATA, True)).persist()
    want, tight = _pairs(blocking.candidates(norm, Blocking())), _pairs(blocking.candidates(norm, catalog.TIGHT))
    assert tight < want
    for name in ("pre_rank_features_wide", "pair_features_wide", "weighted_rankings_native_wide", "fuzz_features"):
        assert _pairs(catalog.QUERIES[name](spark, DATA)) == want, name


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n.endswith("_wide")])
def test_wide_queries_say_what_their_sql_says(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, want = catalog.QUERIES[name](spark, DATA), db.execute(catalog.ORACLES[name]).fetchall()
    assert got.columns == [c[0] for c in db.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_models_run_with_the_production_settings(spark, monkeypatch):
    seen = {}
    for plan in ("two_stage", "pre_rank_recall"):

        def held(*args, plan=plan, sign=inspect.signature(getattr(linkage, plan)), **more):
            bound = sign.bind(*args, **more)
            bound.apply_defaults()
            seen.setdefault(plan, []).append(bound.arguments)

        monkeypatch.setattr(linkage, plan, held)
    for name in ("learned_pre_ranker", "two_stage_light", "two_stage"):
        catalog.QUERIES[name](spark, DATA)
    assert [(a["cfg"], a["most"], a["trees"], a["light"]) for a in seen["two_stage"]] == [(Blocking(), 60, 20, True), (Blocking(), 60, 20, False)]
    assert [(a["cfg"], a["trees"]) for a in seen["pre_rank_recall"]] == [(Blocking(), 20)]


def test_weighted_rankings_see_all_candidates(spark, monkeypatch):
    taken = []
    real = blocking.candidates
    monkeypatch.setattr(blocking, "candidates", lambda norm, cfg: taken.append(cfg) or real(norm, cfg))
    got = catalog.QUERIES["weighted_rankings"](spark, DATA)
    assert taken == [Blocking()] and got.select("ranking").distinct().count() == len(features.HAND_WEIGHTS)


def test_learnt_models_reach_their_floors(spark):
    """Floors of the learnt queries on the small table, whose true pairs share most of a name."""
    at = {r.cap: r.recall for r in catalog.QUERIES["learned_pre_ranker"](spark, "/root/testdata/sf0.01").collect()}
    assert at[10] >= 0.9
    for name in ("two_stage_light", "two_stage"):
        assert max(r.macro_f_beta for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()) >= 0.85, name
    one = catalog.QUERIES["pre_ranker_by_country"](spark, "/root/testdata/sf0.01").collect()
    assert {r.country for r in one} >= {"en"} and all(r.recall is None or r.recall >= 0.8 for r in one if r.cap == 150)
