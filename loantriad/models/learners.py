"""Single learners and the shared scoring helpers.

Every fitted model used here adds ``prob`` (probability or score of class 1) and ``pred`` (0/1) through
``score``. Trees are MLlib trees: the operator contract is kept, numbers of other libraries are not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from loantriad.models.descent import GROUP, Stored, descend

Learner = Callable[[], Estimator]
BASE = {"featuresCol": "features", "labelCol": "y"}


def gradient_boosting(rounds: int = 100, rate: float = 0.05, depth: int = 5, seed: int = 42) -> Estimator:
    return GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, **BASE)


def random_forest(trees: int = 100, depth: int = 8, seed: int = 42, weight: str | None = None) -> Estimator:
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **BASE)
    return model.setWeightCol(weight) if weight else model


def decision_tree(min_leaf: int = 2, depth: int = 8, seed: int = 42, weight: str | None = None) -> Estimator:
    model = DecisionTreeClassifier(impurity="gini", minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed, **BASE)
    return model.setWeightCol(weight) if weight else model


def logistic(rounds: int = 1000, weight: str | None = None) -> Estimator:
    model = LogisticRegression(maxIter=rounds, **BASE)
    return model.setWeightCol(weight) if weight else model


def linear_svm(rounds: int = 100, many_classes: bool = False) -> Estimator:
    model = LinearSVC(maxIter=rounds, **BASE)
    return OneVsRest(classifier=model, **BASE) if many_classes else model


def gaussian_bayes() -> Estimator:
    return NaiveBayes(modelType="gaussian", **BASE)


def perceptron(inputs: int, hidden: tuple[int, ...] = (100,), classes: int = 2, rounds: int = 300, seed: int = 42) -> Estimator:
    return Perceptron([inputs, *hidden, classes], rounds, seed=seed)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Feature vector from numeric columns; rows with a missing feature are an error, so impute first."""
    typed = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=out).transform(typed)


def balanced_weights(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """Add n / (classes * n_class) per row."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("too many classes to weigh")
    total = sum(r.n for r in rows)
    weight = F.lit(None).cast("double")
    for r in rows:
        weight = F.when(F.col(label) == F.lit(r[label]), total / (len(rows) * r.n)).otherwise(weight)
    return df.withColumn(out, weight)


class Perceptron(Estimator):
    """MLlib's perceptron of sigmoid layers with a softmax on top, fitted by its optimiser and loss, some hundred rows at a time.

    The loss is, as there, the mean over groups of 128 rows of a partition (the last may be smaller) of their mean cross entropy.
    """

    def __init__(self, layers: list[int], rounds: int = 100, tolerance: float = 1e-6, seed: int = 42):
        super().__init__()
        self.layers, self.rounds, self.tolerance, self.seed = layers, rounds, tolerance, seed

    def _fit(self, df: DataFrame) -> MultilayerPerceptronClassificationModel:
        return self.fitted(df)[0]

    def start(self, df: DataFrame) -> np.ndarray:
        """The weights that MLlib begins with."""
        spark = df.sparkSession
        sizes = spark.sparkContext._gateway.new_array(spark._jvm.int, len(self.layers))
        for i, n in enumerate(self.layers):
            sizes[i] = n
        model = spark._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True).model(self.seed)
        return _java2py(spark.sparkContext, model.weights()).toArray()

    def fitted(self, df: DataFrame) -> tuple[MultilayerPerceptronClassificationModel, list[float]]:
        """The model, and the losses by round."""
        layers = self.layers
        with Stored(df) as rows:
            found = rows.sum(lambda x, y: np.array([len(group_shares(len(y))[1]), x.shape[1] != layers[0], np.count_nonzero(~np.isin(y, range(layers[-1])))], float))
            if found[1] or found[2]:
                raise ValueError(f"{layers[0]} features and labels from 0 to {layers[-1] - 1} are expected")

            def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
                total = rows.sum(lambda x, y: cross_entropy(weights, layers, x, y)) / found[0]
                return float(total[0]), total[1:]

            weights, losses = descend(loss, self.start(df), self.rounds, self.tolerance)
        spark = df.sparkSession
        made = spark._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(
            f"mlpc_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(weights)))
        return MultilayerPerceptronClassificationModel(made)._set(layers=layers, **BASE), losses


def group_shares(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block one by the size of its group, and the sizes of the groups."""
    sizes = np.diff([*range(0, rows, GROUP), rows])
    return np.repeat(1 / sizes, sizes), sizes


def cross_entropy(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, rows: int = 256) -> np.ndarray:
    """Loss and its gradient, summed over the groups of a block."""
    out = np.zeros(1 + len(weights))
    parts, into, at = [], [], 0
    for n, m in zip(layers, layers[1:]):  # inputs x outputs, then the offsets
        parts.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        into.append((out[1 + at:1 + at + n * m].reshape(n, m), out[1 + at + n * m:1 + at + n * m + m]))
        at += (n + 1) * m
    share, label = group_shares(len(y))[0], y.astype(np.int64)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for first in range(0, len(x), rows):
            part = slice(first, first + rows)
            seen = [x[part]]
            for w, b in parts[:-1]:
                z = seen[-1] @ w
                z += b
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                seen.append(np.reciprocal(z, out=z))
            z = seen[-1] @ parts[-1][0] + parts[-1][1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            wanted = np.eye(layers[-1])[label[part]]
            out[0] -= share[part] @ (wanted * np.log(z)).sum(axis=1)
            delta = (z - wanted) * share[part][:, None]
            for k in range(len(parts) - 1, -1, -1):
                into[k][0][...] += seen[k].T @ delta
                into[k][1][...] += delta.sum(axis=0)
                if k:
                    delta = delta @ parts[k][0].T
                    delta *= seen[k]
                    delta *= 1 - seen[k]
    return out


MADE = ("rawPrediction", "probability", "prediction")


def score(model: Model, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
    """Add ``prob`` and ``pred``; a margin classifier's score is squashed to (0, 1)."""
    out = model.transform(df)
    if "probability" in out.columns:
        chance = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        chance = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    elif "prob" in out.columns:
        return out.withColumnsRenamed({"prob": prob, "pred": pred})
    else:
        chance = F.col("prediction")
    return out.withColumns({prob: chance, pred: F.col("prediction").cast("int")}).drop(*MADE)


def area(df: DataFrame, prob: str = "prob", label: str = "y") -> float:
    """Exact ROC area (no binning)."""
    return BinaryClassificationEvaluator(rawPredictionCol=prob, labelCol=label, numBins=0).evaluate(
        df.select(prob, F.col(label).cast("double").alias(label))
    )


def importances(model: Model, columns: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, or absolute weights of a linear one."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = [abs(float(v)) for v in model.coefficients]
    return [(c, float(v)) for c, v in zip(columns, values)]
