"""Machines fitted by passes over stored inputs go through the same losses as MLlib's."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loantriad.models import descent as de
from loantriad.models import learners as le
from loantriad.models import machines as ma
from loantriad.session import is_stored


@pytest.fixture(scope="module")
def rings(spark):
    rng, rows = random.Random(2), []
    for i in range(700):
        r, t = (1.0 if i % 2 else 2.0) + rng.gauss(0, 0.4), rng.uniform(0, 6.28)
        rows.append((i % 2, r * np.cos(t), r * np.sin(t), 5.0))
    kinds = "y int, a double, b double, same double"
    return le.assemble(spark.createDataFrame([(y, float(a), float(b), c) for y, a, b, c in rows], kinds).repartition(3), ["a", "b", "same"]).cache()


def test_radial_machine_stores_inputs_only(rings, monkeypatch):
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True).fit(rings)
    fourier = ma.FourierFeatures(3, 40, 1 / 3, 42)
    spec = ma.RadialModel(scaler, fourier, None)
    theirs = le.linear_svm(12).fit(spec.mapped(rings.select("y", "features")).select("y", "features"))
    model, losses = ma.hinge_machine(le.linear_svm(12), scaler.transform(rings), "_scaled", fourier)
    assert np.allclose(losses, theirs.summary().objectiveHistory, rtol=1e-9)
    assert np.allclose(model.coefficients.toArray(), theirs.coefficients.toArray(), rtol=1e-6, atol=1e-9) and model.intercept == pytest.approx(theirs.intercept)

    def no(*_):
        raise AssertionError("MLlib's machine stores all features of all rows")

    monkeypatch.setattr(LinearSVC, "_fit", no)
    kept, real = [], de.materialise
    monkeypatch.setattr(de, "materialise", lambda df, name: kept.append(real(df, name)) or kept[-1])
    scored = le.score(ma.RadialMachine(40, learner=lambda: le.linear_svm(12)).fit(rings), rings)
    assert scored.where("prob between 0 and 1").count() == 700 and le.area(scored) > 0.9
    assert len(kept) == 1 and not is_stored(kept[0])  # the inputs are deleted after the last pass


def test_halves_are_shifted_cosines():
    fourier, x = ma.FourierFeatures(3, 50, 0.5), np.random.default_rng(1).normal(size=(600, 3)) * 4
    got = np.concatenate([half for _, half in fourier.halves(x)])
    assert np.allclose((2 * got - 1) * np.sqrt(2 / 50), fourier.numpy(x), atol=1e-12)


def test_a_penalty_is_left_to_the_learner(rings):
    assert ma.plain_hinge(le.linear_svm()) and not ma.plain_hinge(LinearSVC(regParam=0.1, **le.BASE)) and not ma.plain_hinge(le.logistic())
    assert ma.RadialMachine(20, learner=lambda: LinearSVC(regParam=0.1, maxIter=3, **le.BASE)).fit(rings).transform(rings).count() == 700


def test_constant_inputs_and_unusable_rows(spark):
    flat = le.assemble(spark.createDataFrame([(i % 3 == 0, 5.0, 0.1) for i in range(60)], "y boolean, a double, b double").selectExpr("int(y) y", "a", "b"), ["a", "b"])
    model = ma.RadialMachine(10).fit(flat).machine
    assert not model.coefficients.toArray().any() and model.intercept == pytest.approx(-1.0)
    for row in ((2, 1.0), (0, float("inf"))):
        rows = spark.createDataFrame([(1, 0.0), row], "y int, a double").select("y", array_to_vector(F.array("a")).alias("f"))
        with pytest.raises(ValueError, match="rows whose label"):
            ma.hinge_machine(le.linear_svm(), rows, "f", ma.FourierFeatures(1, 5))


def test_descent_ends_at_the_minimum():
    calls = []

    def bowl(x):
        calls.append(1)
        return float(((x - 3) ** 2).sum() + 1), 2 * (x - 3)

    for orthants in (False, True):
        found, losses = de.descend(bowl, np.zeros(3), 50, 1e-9, orthants)
        assert np.allclose(found, 3, atol=1e-3) and losses == sorted(losses, reverse=True)
    calls.clear()
    assert de.descend(bowl, np.full(3, 3.0), 50, 1e-9)[1] == [1.0] and calls == [1]
