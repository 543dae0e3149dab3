"""The perceptron goes through the losses of MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier

from loantriad.models import learners as le


def test_perceptron_goes_through_the_same_losses(spark):
    """Some hundred rows at a time, in three partitions whose last groups are not full."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 3))
    rows = [(int(a * b > 0), float(a), float(b), float(c)) for a, b, c in x]
    rings = le.assemble(spark.createDataFrame(rows, "y int, a double, b double, c double").repartition(3), ["a", "b", "c"]).cache()
    ours, losses = le.perceptron(3, (6, 4), rounds=4).fitted(rings)
    theirs = MultilayerPerceptronClassifier(layers=[3, 6, 4, 2], maxIter=4, seed=42, **le.BASE).fit(rings)
    assert np.allclose(losses, theirs.summary().objectiveHistory, rtol=1e-8)
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), rtol=1e-4, atol=1e-6)
    assert [r.prediction for r in ours.transform(rings).select("prediction").collect()] == [r.prediction for r in theirs.transform(rings).select("prediction").collect()]


def test_gradient_of_the_cross_entropy():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(300, 2)), rng.integers(0, 3, 300).astype(float), rng.normal(size=2 * 4 + 4 + 4 * 3 + 3)
    found = le.cross_entropy(w, [2, 4, 3], x, y, rows=100)
    assert np.allclose(found, le.cross_entropy(w, [2, 4, 3], x, y))
    for k in (0, 9, 15, 26):
        step = np.zeros(len(w))
        step[k] = 1e-6
        slope = (le.cross_entropy(w + step, [2, 4, 3], x, y)[0] - le.cross_entropy(w - step, [2, 4, 3], x, y)[0]) / 2e-6
        assert found[1 + k] == pytest.approx(slope, abs=1e-4)
    share, sizes = le.group_shares(300)
    assert list(sizes) == [128, 128, 44] and share.sum() == pytest.approx(3) and share[-1] == 1 / 44


def test_rows_that_cannot_be_learnt_from(spark):
    df = le.assemble(spark.createDataFrame([(0, 1.0), (2, 2.0)], "y int, a double"), ["a"])
    with pytest.raises(ValueError, match="labels from 0 to 1"):
        le.perceptron(1).fit(df)
    with pytest.raises(ValueError, match="no rows"):
        le.perceptron(1).fit(df.where("y > 5"))
