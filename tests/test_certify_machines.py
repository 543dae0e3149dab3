"""Certified search against brute force, pairwise and radial machines, sparse one-hot."""

import math
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loantriad.models import learners as le
from loantriad.models import machines as ma
from loantriad.operators import certify as ce
from loantriad.operators import encode as en
from loantriad.operators import search as sr


@pytest.fixture(scope="module")
def priced(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        pn = rng.choice([0.0, 10.0, rng.uniform(1, 500)])
        p = rng.choice([rng.random(), 0.5])
        rows.append((p if i % 50 else None, pn, pn + rng.choice([0.0, rng.uniform(10, 2000)]) if i % 70 else None, int(rng.random() < p) if i % 40 else None))
    return spark.createDataFrame(rows, "p_default double, lam_pn double, lam_np double, y int").cache()


def test_no_choice_keeps_the_boundary_small(spark, priced):
    """A sixth of the loans has no losses at all and stays in the boundary."""
    found = ce.certified_search(priced, 0.1)
    assert (found.u, found.open_boxes, found.lower, found.gap) == (None, 0, math.inf, 0.0)


@pytest.mark.parametrize("share", [0.25, 0.3, 1.0])
def test_brute_force_never_beats_the_bound(spark, priced, share):
    found = ce.certified_search(priced, share, 0.02, passes=14, eps=0.0)
    scores = [r for r in sr.objectives(priced, sr.grid(60, 0.0)).collect() if r.bnd <= share * r.n]
    assert scores
    assert min(r.f1 for r in scores) >= found.lower - 1e-6
    at = sr.objectives(priced, [(found.u, found.v)]).first()
    assert at.f1 == pytest.approx(found.cost) and at.bnd == found.boundary <= share * at.n
    assert found.gap >= 0
    assert found.gap <= 0.02 * abs(found.cost) + 1e-9 or found.passes == 14


def test_bounds_hold_at_every_choice_of_a_box():
    rng = np.random.default_rng(3)
    p, pn = rng.random(300).round(2), rng.choice([0.0, 1.0, 7.0, -2.0, np.nan], 300)
    np_, y = pn + rng.choice([0.0, 5.0, 50.0], 300), rng.choice([0.0, 1.0, np.nan], 300)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(300):
            u0, v0 = rng.random(2) * 0.9
            box = (u0, u0 + rng.random() * 0.2, v0, v0 + rng.random() * 0.2)
            low, sure = ce._bound(p, pn, np_, y, box)
            for _ in range(10):
                u, v = rng.uniform(*box[:2]), rng.uniform(*box[2:])
                if u + v <= 1:
                    cost, bnd = ce._price(p, pn, np_, y, u, v)
                    assert low <= cost + 1e-9 and sure <= bnd


def test_what_boxes_share_is_worked_out_once_a_batch(monkeypatch):
    rng, made, real = np.random.default_rng(3), [], ce._Shared.of
    loans = pa.table([rng.random(100), rng.random(100), 2 * rng.random(100), (rng.random(100) < 0.3) * 1.0], names=["p", "pn", "np", "y"])
    boxes = [(i / 4, (i + 1) / 4, 0.0, 0.25) for i in range(3)]
    each = [next(ce._pass([box], 1e-9)(iter(loans.to_batches(50)))) for box in boxes]
    monkeypatch.setattr(ce._Shared, "of", lambda *a: made.append(1) or real(*a))
    found = next(ce._pass(boxes, 1e-9)(iter(loans.to_batches(50))))
    assert len(made) == 2
    assert [list(r.values())[1:] for r in found.to_pylist()] == [list(e.to_pylist()[0].values())[1:] for e in each]


def test_no_loans(spark):
    empty = spark.createDataFrame([], "p_default double, lam_pn double, lam_np double, y int")
    assert ce.certified_search(empty).cost == 0.0


def test_pairwise_votes(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), *map(float, c + rng.normal(0, 0.6, 2))) for k, c in enumerate(np.array([[0, 0], [3, 0], [0, 3], [3, 3]])) for _ in range(60)]
    df = le.assemble(spark.createDataFrame(rows, "y int, a double, b double"), ["a", "b"])
    model = ma.PairwiseMachines().fit(df)
    assert sorted(model.machines) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    out = model.margins(df.select("y", "features")).collect()
    wanted = []
    for r in out:
        votes = {k: [0, 0.0] for k in range(4)}
        for low, high in model.machines:
            m = r[f"_margin_{low}_{high}"]
            votes[high if m > 0 else low][0] += 1
            votes[high][1] += 1 / (1 + math.exp(-m))
            votes[low][1] += 1 / (1 + math.exp(m))
        wanted.append((r.y, max(votes, key=lambda k: (*votes[k], -k))))
    got = [(r.y, int(r.prediction)) for r in model.transform(df.select("y", "features")).collect()]
    assert got == wanted
    assert sum(a == b for a, b in got) > 220
    with pytest.raises(ValueError):
        ma.PairwiseMachines(limit=3).fit(df)


def test_machines_are_fitted_side_by_side(spark):
    """Every fit waits for another one to begin, which a loop over the pairs never reaches."""
    met = threading.Barrier(2, timeout=20)

    class Waits(Estimator):
        def _fit(self, df):
            met.wait()
            return le.linear_svm(2).fit(df)

    rows = [(i % 4, float(i % 4), float(i)) for i in range(40)]
    df = le.assemble(spark.createDataFrame(rows, "y int, a double, b double"), ["a", "b"])
    assert len(ma.PairwiseMachines(Waits, parallelism=2).fit(df).machines) == 6


def test_one_class_and_unlabelled_rows(spark):
    df = le.assemble(spark.createDataFrame([(4, 1.0), (None, 2.0)], "y int, a double"), ["a"])
    assert [r.prediction for r in ma.PairwiseMachines().fit(df).transform(df).collect()] == [4.0, 4.0]


def test_radial_machine_tells_rings(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        r, t = (1.0 if i % 2 else 2.0) + rng.gauss(0, 0.15), rng.uniform(0, 2 * math.pi)
        rows.append((i % 2, r * math.cos(t), r * math.sin(t)))
    df = le.assemble(spark.createDataFrame(rows, "y int, a double, b double"), ["a", "b"])
    straight = le.area(le.score(le.linear_svm().fit(df), df))
    out = le.score(ma.RadialMachine(80, learner=lambda: le.linear_svm(20)).fit(df), df)
    assert out.schema["features"] == df.schema["features"] and len(out.first().features) == 2
    assert le.area(out) > 0.97 > 0.7 > straight


def test_kernel_error(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    worst = {}
    for size in (50, 5000):
        z = ma.FourierFeatures(3, size, 0.5).numpy(x)
        worst[size] = np.abs(z @ z.T - exact).max()
    assert worst[5000] < 0.08 < worst[50]
    fourier = ma.FourierFeatures(3, 20, 0.5)
    df = le.assemble(spark.createDataFrame(x[:5].tolist(), "a double, b double, c double"), ["a", "b", "c"])
    got = [r.z for r in df.select(vector_to_array(fourier.vector("features")).alias("z")).collect()]
    assert np.allclose(got, fourier.numpy(x[:5]))


def test_fourier_features_are_made_a_batch_at_a_time(spark):
    fourier = ma.FourierFeatures(2, 5, 0.5)
    rows = [(0, [0.5, -1.0]), (1, None), (2, [2.0, 0.0]), (3, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>").coalesce(1).withColumn("z", fourier.array(F.col("x")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan  # lambdas are interpreted, row by row
    got = {r.id: r.z for r in df.collect()}
    assert got[1] is None and np.isnan(got[3]).all()
    assert np.allclose([got[0], got[2]], fourier.numpy(np.array([rows[0][1], rows[2][1]])))
    assert df.where("x is null").select("z").collect()[0].z is None and df.where("id > 9").collect() == []


def test_one_hot_vector_is_the_dense_form(spark):
    rows = [(i, random.Random(i).choice(["b", "a", None, "c"]), "only", str(i % 7), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s string, o string, t string, x double")
    got = {r.i: r.v for r in en.one_hot_vector(df, ["s", "o", "t"], ["x"]).select("i", vector_to_array("features").alias("v")).collect()}
    dense = en.one_hot(df, ["s", "o", "t"])
    names = dense.columns[2:]
    assert got == {r.i: [r.x, *[float(r[n]) for n in names]] for r in dense.collect()}


def test_one_hot_vector_of_many_values(spark):
    df = spark.range(100_000).select("id", F.format_string("%06d", "id").alias("s"), F.lit(None).cast("string").alias("n"))
    out = en.one_hot_vector(df, ["s", "n"])
    row = out.where("id = 99999").first()
    assert row.features.size == 99_999 and list(row.features.indices) == [99_998]
    assert out.where("id in (0, 1, 500)").select(en.filled_places("features").alias("p"), "id").orderBy("id").collect() == [([], 0), ([0], 1), ([499], 500)]
