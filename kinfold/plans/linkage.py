"""Training and prediction end to end, without loops over countries or chunks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import blocking, blockwise, features, metric, outputs, pairs
from kinfold.plans import diagnostics, models
from kinfold.runtime import keep
from kinfold.sources.tsv import write_csv


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    threshold: float
    macro_f_beta: float
    curve: list[tuple[float, float]]
    report: dict  # recall by country and of all, rows, entities, trees, importances

    def save(self, spark, path: str, cfg: blocking.Blocking) -> None:
        """The model, and beside it a JSON row with what else a run needs."""
        models.save(self.model, f"{path}/model")
        meta = {"threshold": self.threshold, "macro_f_beta": self.macro_f_beta, "curve": self.curve, "features": list(features.ALL), "blocking": asdict(cfg)}
        spark.createDataFrame([(json.dumps(meta | self.report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        write_csv(spark.createDataFrame(self.curve, "threshold double, macro_f_beta double").coalesce(1), f"{path}/threshold_curve", "overwrite")


def load_meta(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first().value)


def raw_candidates(records: DataFrame, cfg: blocking.Blocking, normalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Normalised records (kept as a table: blocking and features both need them) and capped candidates."""
    norm = keep(blocking.normalised(records, cfg.ngram, normalise), "norm")
    return norm, blocking.top_candidates(blocking.candidates(norm, cfg), cfg.most_candidates)


def train(records: DataFrame, truth: DataFrame, cfg: blocking.Blocking = blocking.Blocking(), trees: int = 50, share: float = 0.15, seed: int = 42, normalise: bool = True) -> Trained:
    """Splits entities, blocks, labels, samples, fits, and chooses the threshold on the entities held out."""
    norm, found = raw_candidates(records, cfg, normalise)
    parts = keep(pairs.split(records.where("source = 1"), share, seed), "split")
    labelled = keep(pairs.labelled(found, truth).join(parts.select("entity_id", "split"), "entity_id"), "labels")
    sample = pairs.sampled(labelled.where("split = 'train'").drop("split"), seed=seed)
    rows = keep(features.features(sample, norm), "features")
    model = models.fit(rows, trees=trees, seed=seed)
    held = parts.where("split = 'val'").select("entity_id")
    scored = models.score(model, features.features(labelled.where("split = 'val'").drop("split"), norm)).select("entity_id", "candidate_id", "score")
    curve = metric.threshold_curve(held, truth.join(held, "entity_id", "left_semi"), scored).orderBy("threshold")
    points = [(r.threshold, r.macro_f_beta) for r in curve.collect()]  # nineteen
    best = max(points, key=lambda p: (p[1], -p[0]))
    return Trained(model, best[0], best[1], points, _report(labelled, truth, parts, rows, model))


def _report(labelled: DataFrame, truth: DataFrame, parts: DataFrame, rows: DataFrame, model: PipelineModel) -> dict:
    """What a run is to be judged by: a row a country, and counts."""
    true = truth.join(parts.select("entity_id", "country"), "entity_id").select("entity_id", "candidate_id", "country")
    by_country = {r.country: {k: v for k, v in r.asDict().items() if k != "country"} for r in pairs.recall(labelled, true, "country").collect()}
    sides = {r.split: r.n for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        "recall_by_country": by_country, "recall": pairs.recall(labelled, true.drop("country")).first().asDict(), "train_rows": rows.count(),
        "validation_rows": labelled.where("split = 'val'").count(), "train_entities": sides.get("train", 0), "validation_entities": sides.get("val", 0),
        "trees": models.trees(model), "importances": models.importances(model),
    }


def predict(records: DataFrame, model: PipelineModel, threshold: float, cfg: blocking.Blocking = blocking.Blocking(), normalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Candidate lists and match lists of all records of source 1, checked."""
    norm, found = raw_candidates(records, cfg, normalise)
    found = keep(found, "candidates")
    scored = keep(models.score(model, features.features(found, norm)).select("entity_id", "candidate_id", "score"), "scores")
    return outputs.build(records.where("source = 1").select("entity_id"), found, scored, records, threshold)


def _found(norm: DataFrame, truth: DataFrame, cfg: blocking.Blocking) -> tuple[DataFrame, DataFrame]:
    """The capped postings, and the true pairs among the candidates, label 1."""
    rows = keep(blocking.capped(blocking.postings(norm, cfg), cfg), "postings")
    return rows, keep(blocking.rendered(blocking.true_pairs(truth, rows)).withColumn("label", F.lit(1)), "found")


def _sampled(norm: DataFrame, rows: DataFrame, true: DataFrame, entities: DataFrame, seed: int, per_positive: int = 6) -> DataFrame:
    """pairs.sampled of all labelled candidates of these entities. Cells draw what can be among the sample, so the other pairs go nowhere."""
    own = true.join(entities.select("entity_id"), "entity_id", "left_semi")
    most = own.groupBy("entity_id").agg((F.count(F.lit(1)) * (per_positive + 1)).alias("most"))  # true ones may be drawn as well
    first = blockwise.drawn(norm, rows, most, per_positive, seed, only=entities)
    negative = blocking.rendered(first).join(true.select("entity_id", "candidate_id"), ["entity_id", "candidate_id"], "left_anti").withColumn("label", F.lit(0))
    return pairs.sampled(keep(own.unionByName(negative), "drawn"), per_positive, per_positive, seed)


def two_stage(records: DataFrame, truth: DataFrame, cfg: blocking.Blocking, most: int = 60, light: bool = True, trees: int = 20, seed: int = 42, normalise: bool = True) -> DataFrame:
    """A pre-ranker on cheap features (``light``) or all, the best ``most`` candidates an entity, a matcher, and its threshold curve on held-out entities.

    All candidates are scored in the cells that find them; only the best leave them.
    """
    norm, truth = keep(blocking.normalised(records, cfg.ngram, normalise), "norm"), keep(truth.select("entity_id", "candidate_id"), "truth")
    rows, true = _found(norm, truth, cfg)
    parts = keep(pairs.split(records.where("source = 1"), 0.15, seed).select("entity_id", "split"), "split")
    columns = features.PRE_RANK if light else features.ALL
    sample = _sampled(norm, rows, true, parts.where("split = 'train'"), seed)
    first = models.fit(keep(features.features(sample, norm, columns), "first"), columns, trees=trees, seed=seed)
    ranks = blocking.rendered(blockwise.best(norm, rows, models.forest(first, columns), most))
    best = keep(pairs.labelled(reranked(ranks, most), true).join(parts, "entity_id"), "best")
    train = pairs.sampled(best.where("split = 'train'").drop("split"), seed=seed)
    second = models.fit(keep(features.features(train, norm), "second"), trees=trees, seed=seed)
    scored = models.score(second, features.features(best.where("split = 'val'").drop("split"), norm)).select("entity_id", "candidate_id", "score")
    held = parts.where("split = 'val'").select("entity_id")
    return metric.threshold_curve(held, truth.join(held, "entity_id", "left_semi"), scored)


def pre_rank_recall(
    records: DataFrame, truth: DataFrame, cfg: blocking.Blocking, caps: tuple[int, ...] = (60, 100, 150), trees: int = 20, seed: int = 42, normalise: bool = True, each_country: bool = False
) -> DataFrame:
    """cap, found, recall of held-out entities' candidates in the order of a pre-ranker learnt on the others; recall is of all their true pairs.

    ``each_country``: a pre-ranker for each country that has true pairs, and country as a column. The cells that find the candidates count
    those ahead of each true one; entities without a true candidate add nothing to any sum. No candidates at all: no rows.
    """
    norm, truth = keep(blocking.normalised(records, cfg.ngram, normalise), "norm"), keep(truth.select("entity_id", "candidate_id"), "truth")
    rows, true = _found(norm, truth, cfg)
    parts = keep(pairs.split(records.where("source = 1"), 0.15, seed), "split")
    columns, group = features.PRE_RANK, F.col("country") if each_country else F.lit("")
    parts = parts.select("entity_id", "split", group.alias("group"))
    sample = _sampled(norm, rows, true, parts.where("split = 'train'"), seed)
    train = keep(features.features(sample, norm, columns).join(parts.select("entity_id", "group"), "entity_id"), "train")
    held, own = parts.where("split = 'val'").drop("split"), truth.join(parts, "entity_id")
    names = sorted(r.group for r in own.select("group").distinct().collect()) if each_country else [""]  # countries are a short list
    rankings = blockwise.Forests([models.forest(models.fit(train.where(F.col("group") == x), columns, trees=trees, seed=seed), columns) for x in names])
    if names:
        single = _single(norm)
        hit = true.join(held, "entity_id").withColumn("ranking", F.array_position(F.array(*map(F.lit, names)), F.col("group")) - 1).where("ranking >= 0")
        made = features.features(hit.select("entity_id", "candidate_id", "match_keys", "n_keys"), single, columns).distinct()
        marked = keep(blockwise.marks(made.join(hit.select("entity_id", "candidate_id", "ranking"), ["entity_id", "candidate_id"]), rankings), "marks")
        ranked = keep(blockwise.ranks(single, rows, marked, rankings, len(names)), "ranks")
        hits = {r.ranking for r in marked.select("ranking").distinct().collect()}
    out = None
    for k, name in enumerate(names):
        one = diagnostics.recall_of_ranks(ranked.where(F.col("ranking") == k), own.where((F.col("group") == name) & (F.col("split") == "val")).select("entity_id", "candidate_id"), caps)
        if k not in hits and not blocking.any_pair(rows, held.where(F.col("group") == name)):
            one = one.limit(0)
        one = one.withColumn("country", F.lit(name)) if each_country else one
        out = one if out is None else out.unionByName(one)
    return out


def _single(norm: DataFrame) -> DataFrame:
    """One row of each id: of repeated ones the first in the order of all their forms."""
    if norm.count() == norm.select("source", "entity_id").distinct().count():
        return norm
    rest = [c for c in norm.columns if c not in ("source", "entity_id")]
    return keep(norm.groupBy("source", "entity_id").agg(F.min(F.struct(*rest)).alias("r")).select("source", "entity_id", "r.*"), "single")


def by_country(plan, records: DataFrame, truth: DataFrame, *args, **more) -> DataFrame:
    """A plan (two_stage or pre_rank_recall) with models of its own for each country, which it adds as a column. Countries are a short list."""
    out = None
    for country in sorted(r.country for r in records.select("country").where("country IS NOT NULL").distinct().collect()):
        own = records.where(F.col("country") == country)
        true = truth.join(own.select("entity_id"), "entity_id", "left_semi")
        if true.isEmpty():  # nothing to learn from
            continue
        one = plan(own, true, *args, **more).withColumn("country", F.lit(country))
        out = one if out is None else out.unionByName(one)
    return out


def reranked(rows: DataFrame, most: int) -> DataFrame:
    """The best candidates of each entity by pre_rank_score, then n_keys, then id; all columns stay."""
    return blocking.top_candidates(rows, most, F.desc("pre_rank_score"), F.desc("n_keys"))
