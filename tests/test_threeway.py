"""Hand-checked cases and properties of the three-way operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from loantriad.operators import search as sr
from loantriad.operators import threeway as tw


@pytest.fixture(scope="module")
def three(spark):
    rows = [(1, 0.1, 10.0, 5.0, 0), (2, 0.5, 20.0, 15.0, 1), (3, 0.8, 30.0, 25.0, 1)]
    return spark.createDataFrame(rows, "loan_id bigint, p_default double, lam_pn double, lam_np double, y int")


def expected(df, u, v):
    cost = tw.expected_cost(F.col("region"), F.col("p_default"), F.col("lam_pn"), F.col("lam_np"), F.lit(u), F.lit(v))
    return [(r.region, r.cost, r.alpha, r.beta) for r in tw.decide(df, u, v).withColumn("cost", cost).orderBy("loan_id").collect()]


def test_free_boundary(three):
    rows = expected(three, 0.0, 0.0)
    assert [r[0] for r in rows] == ["BND"] * 3
    assert sum(r[1] for r in rows) == 0
    assert sum(r[2] - r[3] for r in rows) == 3


def test_closed_boundary(three):
    rows = expected(three, 0.5, 0.5)
    assert [r[0] for r in rows] == ["NEG", "NEG", "POS"]
    assert sum(r[1] for r in rows) == pytest.approx(14.0)
    assert [round(r[2], 4) for r in rows] == [0.6667, 0.5714, 0.5455]


def test_zero_interest(spark):
    df = spark.createDataFrame([(0.0, 100.0)], "lam_pn double, lam_np double")
    assert tw.with_thresholds(df, 0.0, 0.4).first().alpha == 1.0
    assert tw.with_thresholds(df, 1.0, 0.0).first().beta == 0.0


def test_order_of_thresholds(spark):
    df = spark.range(1, 200).select((F.col("id") * 3.0).alias("lam_pn"), (F.col("id") * 3.0 + 500).alias("lam_np"))
    for u, v in itertools.product((0.1, 0.35, 0.5, 0.8), (0.1, 0.3, 0.45, 0.7)):
        wrong = tw.with_thresholds(df, u, v).where((F.col("alpha") >= F.col("beta")) != F.lit(u + v <= 1))
        assert wrong.count() == 0


def test_pass_equals_row_by_row(three):
    cands = sr.grid(4)
    for cost, width in (("realised", "all"), ("expected", "bnd")):
        got = {(r.u, r.v): r for r in sr.objectives(three, cands, cost=cost, width=width).collect()}
        assert len(got) == len(cands)
        for u, v in cands:
            pricing = tw.expected_cost if cost == "expected" else tw.realised_cost
            who = F.col("p_default") if cost == "expected" else F.col("y")
            price = pricing(F.col("region"), who, F.col("lam_pn"), F.col("lam_np"), F.lit(u), F.lit(v))
            rows = tw.decide(three, u, v).withColumn("cost", price).collect()
            assert got[u, v].f1 == pytest.approx(sum(r.cost for r in rows))
            gaps = [r.alpha - r.beta for r in rows if width == "all" or r.region == "BND"]
            assert got[u, v].f2 == pytest.approx(sum(gaps))
            assert got[u, v].bnd == sum(r.region == "BND" for r in rows)


def test_front_is_mutually_undominated(spark):
    rows = [(float(i), float(i * 37 % 11), float(i * 53 % 13)) for i in range(60)]
    df = spark.createDataFrame(rows, "u double, f1 double, f2 double")
    got = {r.u for r in sr.front(df).collect()}
    want = {
        a[0] for a in rows
        if not any(b[1] <= a[1] and b[2] <= a[2] and (b[1] < a[1] or b[2] < a[2]) for b in rows)
    }
    assert got == want


def scores(spark, rows):
    return spark.createDataFrame(
        rows, "u double, v double, f1 double, f2 double, bnd bigint, tp bigint, tn bigint, fp bigint, fn bigint, n bigint"
    )


def test_rules(spark):
    df = scores(spark, [
        (0.0, 0.0, 1.0, 9.0, 90, 5, 5, 0, 0, 100),
        (0.1, 0.1, 2.0, 5.0, 4, 50, 40, 5, 5, 100),
        (0.2, 0.2, 3.0, 1.0, 2, 30, 40, 15, 15, 100),
    ])
    assert sr.choose(df, "cost").first().u == 0.0
    assert sr.choose(df, "boundary").first().u == 0.2
    assert sr.choose(df, "accuracy").first().u == 0.1
    assert sr.choose(df, "width").first().u == 0.2


def test_accuracy_rule_falls_back(spark):
    df = scores(spark, [(0.0, 0.0, 1.0, 9.0, 90, 5, 5, 0, 0, 100), (0.1, 0.1, 2.0, 5.0, 40, 50, 40, 5, 5, 100)])
    assert sr.choose(df, "accuracy").first().u == 0.1


def test_zoom_never_worse(three):
    coarse, _ = sr.search(three, 4, 0, "width")
    fine, _ = sr.search(three, 4, 2, "width")
    assert fine.agg(F.min("f1")).first()[0] <= coarse.agg(F.min("f1")).first()[0]
    assert fine.count() > coarse.count()
    assert fine.select("u", "v").distinct().count() == fine.count()


def test_resolution_leaves_no_boundary(three):
    out = tw.decide(three, 0.0, 0.0)
    second = out.select("loan_id", F.lit(1).alias("pred"))
    assert tw.resolve_boundary(out, second).where("final_pred is null").count() == 0


def test_unknown_arguments(three):
    with pytest.raises(ValueError):
        tw.loss_columns(three, "other")
    with pytest.raises(ValueError):
        sr.choose(three, "other")


def test_many_candidates_take_several_passes(three, monkeypatch):
    whole = sr.objectives(three, sr.grid(6)).orderBy("u", "v").collect()
    monkeypatch.setattr(sr, "PASS_CANDIDATES", 5)
    assert sr.objectives(three, sr.grid(6)).orderBy("u", "v").collect() == whole


def test_strict_triangle():
    assert all(u + v < 1 for u, v in sr.grid(20)) and len(sr.grid(20)) == 210 and len(sr.grid(20, 0.0)) == 231
    assert all(u + v < 1 for u, v in sr.zoom(sr.grid(4), 0.25))


def test_sensitivity_table(three):
    rows = sr.sensitivity(three, [2, 4], rounds=1).collect()
    assert [r.steps for r in rows] == [2, 4] and all(r.seconds > 0 for r in rows)
    assert rows[1].cost is not None and all(r.bnd >= 0 for r in rows)


def test_strict_search_leaves_a_boundary(three):
    _, (u, v) = sr.search(three, 4, 1, "boundary")
    assert u + v < 1


def test_missing_values_as_in_the_decision(spark):
    rows = [(1, 0.9, 10.0, 50.0, 1), (2, None, 10.0, 50.0, 0), (3, float("nan"), 10.0, 50.0, 1), (4, 0.1, None, 50.0, 0), (5, 0.1, 10.0, 50.0, None)]
    df = spark.createDataFrame(rows, "loan_id long, p_default double, lam_pn double, lam_np double, y int")
    got = sr.objectives(df, [(0.3, 0.4)]).first()
    placed = tw.decide(df, 0.3, 0.4).groupBy("region").count().collect()
    assert got.n == 5 and got.bnd == {r.region: r["count"] for r in placed}["BND"] == 3
