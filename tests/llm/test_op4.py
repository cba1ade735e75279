import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.llm.op4_quality_qda import NAMES, SHRINK_TO_DIAGONAL, SHRINK_TO_POOLED, fit, scored, statistics_of

DATA = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(out.doc_id, out.held_out, strict=True))
    held = out.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9


def test_statistics_are_finite_and_local():
    texts = ["a b c", None, "", "é" * 10, "| | |\n| |", "x" * 50_000, "1 2 3 4", "The end. The end.\nThe end."]
    x = statistics_of(pa.array(texts))
    assert x.shape == (len(texts), len(NAMES)) and np.isfinite(x).all()
    for i, t in enumerate(texts):  # a text's row doesn't depend on its neighbours
        assert np.allclose(statistics_of(pa.array([t], pa.string()))[0], x[i])


def test_no_labels_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (3, None), (3, None)], "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("y", F.lit(2))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in scored(docs, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, None, 0), (3, 5, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.score for r in scored(docs, odd).collect()] == [0.5] * 4
    assert scored(docs.limit(0), odd).collect() == []


def density(x, rows, pooled):
    """Log density of a class by its shrunk covariance, without factors: the determinant and a solved system."""
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    unit = np.outer(scale, scale)
    target = (1 - SHRINK_TO_DIAGONAL) * pooled / unit + SHRINK_TO_DIAGONAL * np.diag(np.diag(pooled / unit))
    cov = (1 - SHRINK_TO_POOLED) * np.cov(rows.T, bias=True) / unit + SHRINK_TO_POOLED * target + 1e-3 * np.eye(len(scale))
    z = (x - rows.mean(axis=0)) / scale
    return -0.5 * (z * np.linalg.solve(cov, z.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1]


def test_against_densities_written_out(spark):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, rng.integers(5, 60))) + (". The end." if i % 3 else " 12 $$ ||\n" * int(rng.integers(1, 5))) for i in range(240)]
    texts[7] = "long " * 200_000
    label = [int(bool(i % 3) ^ bool(rng.random() < 0.1)) for i in range(240)]
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, y, 0) for i, y in enumerate(label)] + [(i, label[i], 1) for i in range(0, 240, 10)]  # some labels twice: they weigh twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(0)).withColumn("score", F.lit("x"))
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y")).withColumn("x", F.lit(None))
    out = {r.doc_id: r.score for r in scored(docs, named).collect()}
    x = statistics_of(pa.array(texts))
    train = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5]
    own = [x[[i for i, y in train if y == c]] for c in (0, 1)]
    n = np.array([len(o) for o in own])
    pooled = sum(len(o) * np.cov(o.T, bias=True) for o in own) / n.sum()
    want = np.log(n[1] / n[0]) + density(x, own[1], pooled) - density(x, own[0], pooled)
    model = fit(spark.createDataFrame([(x[i].tolist(), y) for i, y in train], "x array<double>, y long"))
    assert np.allclose(model.difference(x), want, rtol=1e-6, atol=1e-6)
    assert np.allclose([out[i] for i in range(240)], 1 / (1 + np.exp(-np.clip(model.slope * want + model.offset, -50, 50))), atol=1e-6)
