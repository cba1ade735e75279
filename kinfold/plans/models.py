"""Boosted trees on features, by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.blockwise import Forest
from kinfold.operators.features import ALL
from kinfold.operators.pairs import uniform


def ready(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Missing embedding scores as -1, at the models' border only: they take no missing values, and a flag says it already."""
    return rows.na.fill(-1.0, [c for c in ("embedding_score",) if c in columns])


def fit(rows: DataFrame, columns: tuple[str, ...] = ALL, trees: int = 50, depth: int = 6, step: float = 0.05, seed: int = 42, stop_share: float = 0.1) -> PipelineModel:
    """A classifier of label; a hash-chosen share of the rows tells when more trees stop helping."""
    train = ready(rows, columns).withColumn("stop", uniform(seed, "entity_id", "candidate_id") < stop_share)
    stops = not train.where("stop").isEmpty()  # few rows may have none
    model = GBTClassifier(
        labelCol="label", featuresCol="x", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.9",
        minInstancesPerNode=30, seed=seed, **({"validationIndicatorCol": "stop"} if stops else {}),
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="x"), model]).fit(train)


def score(model: PipelineModel, rows: DataFrame, columns: tuple[str, ...] = ALL, name: str = "score") -> DataFrame:
    """rows with the model's probability of a match; of repeated pairs one row stays."""
    out = model.transform(ready(rows, columns).dropDuplicates(["entity_id", "candidate_id"]))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def forest(model: PipelineModel, columns: tuple[str, ...]) -> Forest:
    """The model's trees, to score rows where they are made."""
    trees = []
    for tree in model.stages[-1].trees:
        nodes: list = []

        def add(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, 0, 0, node.prediction()))
            if node.subtreeDepth():
                split = node.split()
                nodes[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), 0.0)
            return at

        add(tree._call_java("rootNode"))
        trees.append(nodes)
    return Forest(trees, list(model.stages[-1].treeWeights), columns)


def importances(model: PipelineModel, columns: tuple[str, ...] = ALL) -> list[tuple[str, float]]:
    return sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda p: (-p[1], p[0]))


def trees(model: PipelineModel) -> int:
    """How many trees the fit kept: growing stops when the rows set aside gain nothing."""
    return model.stages[-1].getNumTrees


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
