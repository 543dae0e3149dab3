"""Learners and ensembles on a separable table: quality floors and contracts."""

import threading

import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from loantriad.models import ensembles as es
from loantriad.models import learners as le
from loantriad.models import selection as se
from loantriad.plans import credit_flow as cf

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(1200).select(
        F.col("id").alias("loan_id"), F.randn(1).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c"), F.randn(4).alias("noise")
    )
    y = (F.col("a") + 0.5 * F.col("b") + 0.3 * F.col("noise") > 0).cast("int")
    return df.withColumn("y", y).drop("noise").repartition(4).cache()


LEARNERS = {
    "gbt": (lambda: le.gradient_boosting(5, 0.1, 3), 0.9),
    "forest": (lambda: le.random_forest(10, 5), 0.9),
    "tree": (lambda: le.decision_tree(2, 5), 0.85),
    "logistic": (lambda: le.logistic(30), 0.95),
    "svm": (lambda: le.linear_svm(15), 0.95),
    "bayes": (le.gaussian_bayes, 0.93),
    "mlp": (lambda: le.perceptron(3, (4,), rounds=40), 0.93),
    "ada": (lambda: es.AdaBoostClassifier(NAMES, 12, store_every=5), 0.9),
    "lda": (lambda: es.LinearDiscriminant(NAMES), 0.95),
    "bagging": (lambda: es.BaggingClassifier(lambda: le.decision_tree(2, 5, weight="copies"), NAMES, "loan_id", 4), 0.9),
    "stacking": (lambda: es.StackingClassifier({"rf": lambda: le.random_forest(4, 3), "lda": lambda: es.LinearDiscriminant(NAMES)}, NAMES, "loan_id", folds=2), 0.93),
    "vote": (lambda: es.VoteClassifier({"tree": lambda: le.decision_tree(2, 4), "lr": lambda: le.logistic(20)}), 0.93),
    "majority": (lambda: es.VoteClassifier({"tree": lambda: le.decision_tree(2, 4), "lr": lambda: le.logistic(20), "nb": le.gaussian_bayes}, "majority"), 0.93),
}


@pytest.mark.parametrize("name", list(LEARNERS))
def test_quality(data, name):
    make, floor = LEARNERS[name]
    df = le.assemble(data, NAMES)
    out = le.score(make().fit(df.where("loan_id % 4 <> 0")), df.where("loan_id % 4 = 0"))
    assert out.count() == 300
    assert out.where("prob < 0 or prob > 1 or prob is null or pred not in (0, 1)").count() == 0
    assert le.area(out) > floor


def test_balanced_weights(data):
    sums = le.balanced_weights(data).groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(600) for r in sums)


def test_out_of_bag(data):
    bags = es.BaggingClassifier(lambda: le.decision_tree(2, 5, weight="copies"), NAMES, "loan_id", 5, 0.8, 0.8).fit(data)
    out = bags.out_of_bag(data)
    seen = out.where("prob is not null")
    assert out.count() == 1200 and 1000 < seen.count() <= 1200
    assert seen.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0] > 0.75


def test_least_cost(spark):
    row = spark.range(1).select(
        es.least_cost_class(F.array(F.lit(0.7), F.lit(0.3)), [[0.0, 1.0], [1.0, 0.0]]).alias("even"),
        es.least_cost_class(F.array(F.lit(0.7), F.lit(0.3)), [[0.0, 1.0], [5.0, 0.0]]).alias("dear"),
        es.least_cost_class(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.4, 0.1, 0.1, 0.1)]), es.uniform_costs(6)).alias("six"),
    ).first()
    assert (row.even, row.dear, row.six) == (0, 1, 2)


def test_elimination(data):
    out = se.eliminate_features(data, "loan_id", NAMES, lambda: le.logistic(20), folds=2, protected=("c",))
    assert "a" in out.chosen and "c" in out.chosen and sorted(out.scores) == [1, 2, 3]
    accuracy = se.eliminate_features(data, "loan_id", NAMES, lambda: le.decision_tree(2, 3), folds=2, scoring="accuracy")
    assert "a" in accuracy.chosen


def test_flow(spark, folder):
    cfg = cf.Settings(
        risk=lambda: le.gradient_boosting(3, 0.1, 3), boundary_tree=lambda: le.decision_tree(2, 4, weight="copies"),
        boundary_bags=2, folds=2, steps=8, rounds=1, rule="cost",
    )
    data = cf.model_table(spark, folder, 2)
    rows, weights = cf.cross_validated(data, cfg)
    got = rows.collect()
    assert sum(r.tp + r.tn + r.fp + r.fn for r in got) == data.count()
    assert all(0 <= r.bacc <= 1 and r.cost >= 0 and r.u + r.v < 1 for r in got)
    assert all(r.bnd > 0 and r.cost != r.cost_before for r in got)  # the second stage has loans to decide
    assert weights.count() == 2 * len(cfg.features)
    single = cf.baselines(data, {"Logistic": lambda: le.logistic(10)}, cfg)
    table = {r.model: r for r in cf.compare(single, rows).collect()}
    assert table["Logistic"].recall is None and table["Proposed"].recall is not None


def test_flow_settings():
    from loantriad.catalog import modelling

    cfg = modelling.flow_settings()
    assert (cfg.folds, cfg.boundary_bags, cfg.steps, cfg.balance, cfg.together, cfg.resolver) == (5, 10, 20, True, True, "forest")


def test_flow_queries_share_one_result(spark, folder, monkeypatch):
    """Three folds of small models end to end; the second query reads what the first stored."""
    from loantriad.catalog import modelling

    runs, made = [], cf.cross_validated
    small = cf.Settings(risk=lambda: le.gradient_boosting(2, 0.3, 3), together=True, resolver="forest", boundary_bags=3, folds=3, steps=8)
    monkeypatch.setattr(modelling, "flow_settings", lambda: small)
    monkeypatch.setattr(cf, "cross_validated", lambda *a: runs.append(1) or made(*a))
    spark.sparkContext.__dict__.pop("_loantriad_flows", None)
    rows = modelling.flow(spark, folder).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and all(r.tp + r.tn + r.fp + r.fn > 0 for r in rows)
    assert modelling.flow_summary(spark, folder).count() == 11 and runs == [1]
    spark.sparkContext.__dict__.pop("_loantriad_flows", None)


def raw_table(spark, n=400):
    from datetime import date, timedelta

    rows = [
        (2**60 + 2 * i + 1, None if i % 50 == 0 else "good" if i % 3 else "late", "oops" if i % 40 == 0 else str(100.0 + i % 7), "?" if i % 20 == 1 else "10",
         None if i % 25 == 2 else float(1 + i % 3), str(i % 5 - (i % 5 == 4) * 9), None if i % 30 == 3 else date(2020, 1, 1) + timedelta(days=i),
         None, "a" if i % 10 else None, float(i % 4) if i % 10 == 0 else None, float(i % 11), 2.0 * (i % 11))
        for i in range(n)
    ]
    kinds = ("loan_id bigint, status string, loan_amount string, loan_rate string, duration_years double, installment_number string, loan_date date, "
             "nothing double, colour string, rare double, first double, second double")
    return spark.createDataFrame(rows, kinds), rows


def test_preparation_by_hand(spark):
    from loantriad.plans.prepare import Roles, feature_names, prepare

    df, rows = raw_table(spark)
    kept = [r for r in rows if r[2] != "oops" and float(r[5]) >= 0]
    out = prepare(df, Roles(good=("good",)))
    assert feature_names(out) == ["loan_amount", "loan_rate", "duration_years", "installment_number", "first", "interest_cash", "loan_date_seconds"]
    got = {r.loan_id: r for r in out.collect()}
    assert set(got) == {r[0] for r in kept}  # large odd ids are not rounded
    known = [r[4] for r in kept if r[4] is not None]
    for r in kept:
        g = got[r[0]]
        assert g.y == int(r[1] != "good") and g.loan_amount == float(r[2]) and g.loan_rate == 10.0
        assert g.duration_years == pytest.approx(sum(known) / len(known) if r[4] is None else r[4])
        assert g.interest_cash == pytest.approx(float(r[2]) * 0.1 * (r[4] or 1.0))
    days = sorted((r[6] - rows[0][6]).days for r in kept if r[6] is not None)
    middle = [got[r[0]].loan_date_seconds for r in kept if r[6] is None]
    want = (days[(len(days) - 1) // 2] + days[len(days) // 2]) / 2 * 86400 + 1577836800
    assert middle and set(middle) == {want}


def test_preparation_without_rows_and_with_many_values(spark):
    from loantriad.plans.prepare import Roles, prepare

    df, rows = raw_table(spark)
    empty = prepare(df.limit(0), Roles(good=("good",)))
    assert empty.columns == ["loan_id", "y"] and empty.count() == 0
    many = df.withColumn("colour", F.col("loan_id").cast("string"))
    out = prepare(many, Roles(good=("good",)), vector="features").select("features").first()
    kept = len([r for r in rows if r[2] != "oops" and float(r[5]) >= 0])
    assert out.features.size == 7 + kept - 1


def test_a_fold_runs_on_the_prepared_table(spark):
    from loantriad.plans.prepare import Roles

    df, _ = raw_table(spark, 1200)
    data, names = cf.prepared_table(df, Roles(good=("good",)), 3)
    cfg = cf.Settings(features=names, risk=lambda: le.logistic(10), resolver="forest", boundary_bags=3, steps=5, folds=3)
    row, weights = cf.run_fold(data, 0, cfg)
    found = row.first()
    assert found.tp + found.fp + found.tn + found.fn == data.where("fold = 0").count() and 0 <= found.auc <= 1


def test_baseline_folds_run_side_by_side(spark):
    """A fit waits for one of another fold, which a loop over the folds never reaches; the rows are those of single folds."""
    met = threading.Barrier(2, timeout=30)

    class Waits(Estimator):
        def _fit(self, df):
            met.wait()
            return le.decision_tree(depth=2).fit(df)

    rows = [(i, i % 2, (i // 2) % 2, 1.0, 2.0, float(i % 2) + (i % 7) / 10, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "loan_id int, y int, fold int, lam_pn double, lam_np double, a double, b double")
    out = cf.baselines(df, {"tree": Waits}, cf.Settings(features=["a", "b"], folds=2)).collect()
    assert sorted((r.fold, r.model, r.tp + r.fn + r.tn + r.fp) for r in out) == [(0, "tree", 30), (1, "tree", 30)]
