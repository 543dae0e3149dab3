"""Support-vector machines beyond the linear two-class one: pairs of classes, and a radial kernel."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from loantriad.models.descent import Stored, descend
from loantriad.models.learners import Learner, linear_svm
from loantriad.session import settle


class PairwiseMachines(Estimator):
    """One two-class machine for each pair of classes, fitted on the rows of those classes only.

    The class with most votes wins; equal votes go to the greater sum of squashed margins, then to the smaller label.
    Labels are whole numbers; rows without one are not learnt from. There are k (k - 1) / 2 machines, so k is limited by the
    argument ``limit``. A machine is fitted in many short jobs, so ``parallelism`` machines are fitted side by side.
    """

    def __init__(self, learner: Learner = linear_svm, label: str = "y", limit: int = 50, parallelism: int = 8):
        super().__init__()
        self.learner, self.label, self.limit, self.parallelism = learner, label, limit, parallelism

    def _fit(self, df: DataFrame) -> "PairwiseModel":
        df = settle(df)
        found = df.where(F.col(self.label).isNotNull()).select(F.col(self.label).cast("int")).distinct().limit(self.limit + 1).collect()
        classes = sorted(r[0] for r in found)
        if not classes:
            raise ValueError("no labelled rows")
        if len(classes) > self.limit:
            raise ValueError(f"more than {self.limit} classes: raise limit, or use one machine a class")

        def one(pair: tuple[int, int]) -> Model:
            rows = df.where(F.col(self.label).isin(*pair)).withColumn(self.label, (F.col(self.label) == pair[1]).cast("double"))
            return self.learner().fit(rows)

        pairs = list(combinations(classes, 2))
        with ThreadPool(self.parallelism) as pool:
            machines = pool.map(inheritable_thread_target(df.sparkSession)(one), pairs, chunksize=1)
        return PairwiseModel(classes, dict(zip(pairs, machines)))


class PairwiseModel(Model):
    def __init__(self, classes: list[int], machines: dict[tuple[int, int], Model]):
        super().__init__()
        self.classes, self.machines = classes, machines

    def margins(self, df: DataFrame) -> DataFrame:
        """Add one margin column per pair, above zero for the higher class."""
        for (low, high), machine in self.machines.items():
            made = [c for c in ("rawPrediction", "probability", "prediction") if c not in df.columns]
            df = machine.transform(df).withColumn(f"_margin_{low}_{high}", vector_to_array("rawPrediction")[1]).drop(*made)
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        ranked = []
        for k in self.classes:
            votes, strength = F.lit(0), F.lit(0.0)
            for low, high in self.machines:
                if k in (low, high):
                    m = F.col(f"_margin_{low}_{high}")
                    votes = votes + ((m > 0) if k == high else (m <= 0)).cast("int")
                    strength = strength + 1 / (1 + F.exp(-m if k == high else m))
            ranked.append(F.struct(votes.alias("votes"), strength.alias("strength"), F.lit(-k).alias("order")))
        out = self.margins(df)
        best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
        return out.withColumn("prediction", (-best["order"]).cast("double")).drop(*[c for c in out.columns if c.startswith("_margin_")])


class FourierFeatures:
    """Random Fourier features of the kernel exp(-gamma |x - y|^2): their inner product tends to the kernel as ``size`` grows.

    The directions depend on the seed only, so tasks and retries agree.
    """

    def __init__(self, inputs: int, size: int = 200, gamma: float = 1.0, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.weights = rng.normal(0.0, np.sqrt(2 * gamma), (size, inputs))
        self.shifts = rng.uniform(0.0, 2 * np.pi, size)

    def array(self, x: Column) -> Column:
        """Array of features of an array of numbers, a batch of rows at a time; missing if the array is."""
        weights, shifts, scale = self.weights, self.shifts, float(np.sqrt(2 / len(self.shifts)))

        @F.arrow_udf("array<double>")
        def features(rows: pa.Array) -> pa.Array:
            there = rows.is_valid()
            flat = rows.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, weights.shape[1])
            out = np.tile(shifts, (len(flat), 1))
            for part, weight in zip(flat.T, weights.T):  # one input after the other, so that a row's sum does not depend on its batch
                out += part[:, None] * weight
            np.cos(out, out=out)
            out *= scale
            ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))]) * len(shifts)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.reshape(-1)), mask=pc.invert(there))

        return features(x)

    def vector(self, features: str) -> Column:
        """Vector of features of a vector column."""
        return array_to_vector(self.array(vector_to_array(features)))

    def numpy(self, x: np.ndarray) -> np.ndarray:
        """The same features of the rows of ``x``, to measure the kernel's error on a few of them."""
        return np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.weights.T + self.shifts)

    def halves(self, x: np.ndarray, rows: int = 128) -> Iterator[tuple[slice, np.ndarray]]:
        """(1 + cosine) / 2 of every feature, few rows at a time, so that they stay in a core's cache.

        It is 1 / (1 + t^2) with the tangent t of half the angle, since numpy has tangents at a fourth of the time of cosines.
        """
        weights, shifts = self.weights.T / 2, self.shifts / 2
        for at in range(0, len(x), rows):
            out = x[at:at + rows] @ weights
            out += shifts
            np.tan(out, out=out)
            out *= out
            out += 1
            yield slice(at, at + rows), np.reciprocal(out, out=out)


def plain_hinge(learner: Estimator) -> bool:
    """Whether ``hinge_machine`` fits what this learner fits: no penalty, no row weights, usual columns and threshold."""
    if not isinstance(learner, LinearSVC) or learner.isSet(learner.weightCol) or learner.getRegParam() or learner.getThreshold():
        return False
    usual = (learner.getFeaturesCol(), learner.getLabelCol(), learner.getPredictionCol(), learner.getRawPredictionCol())
    return learner.getFitIntercept() and usual == ("features", "y", "prediction", "rawPrediction")


def hinge_machine(learner: LinearSVC, df: DataFrame, inputs: str, fourier: FourierFeatures) -> tuple[LinearSVCModel, list[float]]:
    """What ``learner`` fits on the Fourier features of a vector column, and its losses by round.

    MLlib's machine stores all features of all rows. Here only the inputs are stored, and every pass makes their features anew.
    """
    size, scale = len(fourier.shifts), 2 * np.sqrt(2 / len(fourier.shifts))  # a feature is scale * (half - 1/2)
    origin = next(fourier.halves(np.zeros((1, fourier.weights.shape[1]))))[1][0]

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Unusable rows, and sums and squares of the halves from those of the mean input: exactly zero if all inputs are constant."""
        out = np.zeros(1 + 2 * size)
        out[0] = np.count_nonzero(~np.isfinite(x).all(axis=1) | ~np.isin(y, (0.0, 1.0)))
        for _, half in fourier.halves(x):
            half -= origin
            out[1:1 + size] += half.sum(axis=0)
            out[1 + size:] += np.einsum("ij,ij->j", half, half)
        return out

    with Stored(df, inputs) as rows:
        n, found = rows.count, rows.sum(moments)
        if found[0]:
            raise ValueError("rows whose label is not 0 or 1, or with a feature that is no finite number")
        first, second = found[1:1 + size], found[1 + size:]
        spread = np.sqrt(np.maximum(second - first * first / n, 0.0) / max(n - 1, 1))
        mean, inverse = origin + first / n, np.divide(1.0, spread, out=np.zeros(size), where=spread > 0)

        def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
            slopes = weights[:-1] * inverse
            offset = weights[-1] - slopes @ mean

            def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                out, sign = np.zeros(2 + size), 2 * y - 1
                for at, half in fourier.halves(x):
                    short = 1 - sign[at] * (half @ slopes + offset)
                    push = np.where(short > 0, -sign[at], 0.0)
                    out[0] += short[short > 0].sum()
                    out[1] += push.sum()
                    out[2:] += push @ half
                return out

            total = rows.sum(one) / n
            return float(total[0]), np.append((total[2:] - total[1] * mean) * inverse, total[1])

        weights, losses = descend(loss, np.zeros(size + 1), learner.getMaxIter(), learner.getTol(), orthants=True)
    slopes, spark = weights[:-1] * inverse / scale, df.sparkSession
    made = spark._jvm.org.apache.spark.ml.classification.LinearSVCModel(
        f"LinearSVC_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(slopes)), float(weights[-1] - slopes @ (mean - 0.5) * scale))
    return LinearSVCModel(made)._set(featuresCol="features", labelCol="y"), losses


class RadialMachine(Estimator):
    """Linear machine on random Fourier features of the standardised inputs.

    ``gamma`` is by default 1 / inputs, as usual on inputs of unit variance. A constant input takes no part.
    """

    def __init__(self, size: int = 200, gamma: float | None = None, seed: int = 42, learner: Learner = linear_svm):
        super().__init__()
        self.size, self.gamma, self.seed, self.learner = size, gamma, seed, learner

    def _fit(self, df: DataFrame) -> "RadialModel":
        scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True).fit(df)
        inputs = len(scaler.mean)
        fourier = FourierFeatures(inputs, self.size, self.gamma or 1 / inputs, self.seed)
        learner = self.learner()
        if plain_hinge(learner):
            return RadialModel(scaler, fourier, hinge_machine(learner, scaler.transform(df.select("y", "features")), "_scaled", fourier)[0])
        # another learner may store the features, all of every row
        return RadialModel(scaler, fourier, learner.fit(RadialModel(scaler, fourier, None).mapped(settle(df.select("y", "features"))).select("y", "features")))


class RadialModel(Model):
    def __init__(self, scaler: Model, fourier: FourierFeatures, machine: Model | None):
        super().__init__()
        self.scaler, self.fourier, self.machine = scaler, fourier, machine

    def mapped(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(df).withColumn("_inputs", F.col("features")).withColumn("features", self.fourier.vector("_scaled")).drop("_scaled")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.machine.transform(self.mapped(df))
        return out.withColumn("features", F.col("_inputs")).drop("_inputs")
