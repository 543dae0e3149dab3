"""Hand-checked cases for cleaning, encoding, ranks, evaluation, sampling and parsing."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loantriad.functions import labels as lb
from loantriad.functions import parsing as ps
from loantriad.operators import clean as cl
from loantriad.operators import correlation as co
from loantriad.operators import encode as en
from loantriad.operators import evaluate as ev
from loantriad.operators import filters as fl
from loantriad.operators import outliers as ou
from loantriad.operators import profile as pr
from loantriad.operators import ranks as rk
from loantriad.operators import sampling as sa
from loantriad.session import scratch_path, small_side
from loantriad.sources import readers as rd
from loantriad.sources.schemas import BANK, FEATURE_METADATA_SCHEMA, MARKETPLACE


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_parsing(spark):
    row = spark.range(1).select(
        ps.parse_int(F.lit("12.5")).alias("strict"), ps.parse_int(F.lit("12.5"), True).alias("lenient"),
        ps.parse_int(F.lit("-12.9"), True).alias("minus"), ps.parse_int(F.lit("9e12"), True).alias("huge"),
        ps.parse_month_year(F.lit("Dec-2015")).cast("string").alias("month"), ps.parse_char(F.lit(" Y ")).alias("flag"),
        ps.clean_quotes(F.lit('"abc" ')).alias("text"), ps.blank_to_null(F.lit(" \t")).alias("blank"),
        ps.parse_date(F.lit("2015-02-30")).alias("day"), ps.parse_long(F.lit("\n7 ")).alias("long"),
    ).first()
    assert row.strict is None and row.lenient == 12 and row.minus == -12 and row.huge == 2147483647
    assert row.month == "2015-12-01" and row.flag == "Y" and row.text == "abc"
    assert row.blank is None and row.day is None and row.long == 7


def test_labels(spark):
    df = column(spark, [None, " جاري ", "جاری", "معوق"], "string")
    assert [r[0] for r in df.select(lb.label_from_good(F.col("x"))).collect()] == [1, 0, 1, 1]
    assert [r[0] for r in df.select(lb.label_from_default(F.col("x"))).collect()] == [0, 0, 0, 1]


def test_schemas():
    assert len(MARKETPLACE) == 151 and len(BANK) == 51
    assert len({n for n, _ in MARKETPLACE}) == 151 and len({n for n, _ in BANK}) == 51


def test_label_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "i int, s string")
    assert [r.s for r in en.encode_labels(df, ["s"]).orderBy("i").collect()] == [2, 1, 0, 2]
    assert [r.code for r in en.factorize(df, "s", "i", "code").orderBy("i").collect()] == [0, 1, -1, 0]


def test_one_hot(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, None)], "i int, s string")
    out = en.one_hot(df, ["s"])
    assert out.columns == ["i", "s_b", "s_c"]
    assert [(r.s_b, r.s_c) for r in out.orderBy("i").collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]
    with pytest.raises(ValueError):
        en.one_hot(df, ["s"], limit=2)


def test_quartiles(spark):
    df = column(spark, [4.0, 1.0, 3.0, 2.0], "double")
    assert rk.percentiles(df, ["x"], [0.25, 0.75], "legacy")["x"] == {0.25: 1.25, 0.75: 3.75}
    assert rk.percentiles(df, ["x"], [0.25, 0.75])["x"] == {0.25: 1.75, 0.75: 3.25}


def test_percentiles_of_nothing(spark):
    df = column(spark, [None, None], "double")
    assert rk.percentiles(df, ["x"], [0.5])["x"] == {0.5: None}


@pytest.mark.parametrize("hot", [0.0, 0.34])
def test_order_statistics_narrow_brackets(spark, hot):
    """Coarse sketch and tiny allowance, so several narrowing rounds run; a third of the rows may be equal."""
    rng = random.Random(3)
    values = [7.0 if rng.random() < hot else rng.expovariate(1) * 100 for _ in range(20_000)]
    df = column(spark, values, "double")
    ranks = [1, 2, 777, 5000, 10_000, 10_001, 19_999, 20_000]
    got = rk.order_statistics(df, {"x": ranks}, accuracy=50, most=40)["x"]
    want = sorted(values)
    assert got == {r: want[r - 1] for r in ranks}


def test_global_index_and_totals(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 5).alias("v"))
    rows = sorted(df.collect(), key=lambda r: r.k)
    got = {r.id: r.rank for r in rk.global_index(df, [F.col("k")]).collect()}
    assert got == {r.id: i + 1 for i, r in enumerate(rows)}
    sums = {r.id: r.s for r in rk.running_totals(df, [F.col("k")], {"s": "v"}).collect()}
    total, want = 0, {}
    for r in rows:
        total += r.v
        want[r.id] = total
    assert sums == want


def test_auc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, p double")
    assert ev.auc(df, "y", "p").first().auc == 0.875
    assert ev.auc(df.where("y = 1"), "y", "p").first().auc is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=40))
def test_auc_equals_pairs(spark, pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    got = ev.auc(spark.createDataFrame(pairs, "y int, p int"), "y", "p").first().auc
    if not pos or not neg:
        assert got is None
    else:
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got == pytest.approx(want)


def test_metrics(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2
    row = ev.evaluate(spark.createDataFrame(rows, "y int, pred int")).first()
    assert (row.tp, row.fn, row.tn, row.fp) == (3, 1, 4, 2)
    assert row.bacc == pytest.approx(0.708333, abs=1e-6) and row.gm == pytest.approx(0.707107, abs=1e-6)
    assert row.precision == pytest.approx(0.6) and row.fm == pytest.approx(0.666667, abs=1e-6)


def test_metrics_of_one_class(spark):
    row = ev.evaluate(spark.createDataFrame([(0, 0)], "y int, pred int")).first()
    assert (row.precision, row.recall, row.fm, row.gm) == (0, 0, 0, 0)


def test_quota_golden_vector(spark):
    # Status counts of the bank table and the quotas for 100,000 rows.
    counts = [426401, 320337, 124465, 85933, 76121, 23633, 17810, 6615, 6247, 4171, 418, 333, 254, 134, 102, 50, 30, 10]
    quotas = [39010, 29306, 11387, 7862, 6964, 2162, 1629, 605, 572, 382, 38, 30, 23, 12, 9, 5, 3, 1]
    df = spark.createDataFrame(list(enumerate(counts)), "status int, n bigint")
    got = {r.status: r.quota for r in sa.proportional_quotas(df, 100_000).collect()}
    assert [got[i] for i in range(18)] == quotas


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 25, 100, 137])
def test_systematic_marks(spark, n):
    import math

    m = math.ceil(n * 0.1)
    step = n / m
    want = sorted({min(int(round(i * step + step / 2)), n - 1) for i in range(m)})
    df = spark.range(n).where(sa.is_marked(F.col("id"), F.lit(n), 0.1))
    assert sorted(r.id for r in df.collect()) == want


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(1003)
    train, test = sa.train_test_split(df, "id", 0.2)
    assert (train.count(), test.count()) == (802, 201)
    assert train.join(test, "id").count() == 0


def test_fold_sizes(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3))
    sizes = sa.stratified_k_fold(df, "id", ["y"], 5).groupBy("y", "fold").count().collect()
    assert len(sizes) == 15 and sum(r["count"] for r in sizes) == 1003
    for y in (None, 1, 2):
        inside = [r["count"] for r in sizes if r.y == y]
        assert max(inside) - min(inside) <= 1
    tiny = sa.stratified_k_fold(spark.range(3).withColumn("y", F.lit(1)), "id", ["y"], 5)
    assert sorted(r.fold for r in tiny.collect()) == [0, 1, 2]
    plain = [r["count"] for r in sa.k_fold(spark.range(1003), "id", 5).groupBy("fold").count().collect()]
    assert sorted(plain) == [200, 200, 201, 201, 201]


def test_bag_rate(spark):
    df = spark.range(20_000)
    out = df.select(sa.poisson_count(sa.bag_draw(F.col("id"), 1), 0.8).alias("c"))
    mean, var = out.agg(F.avg("c"), F.var_samp("c")).first()
    bag = sa.bootstrap(df, "id", 1, 0.8)
    assert bag.count() == out.where("c > 0").count() and bag.where("copies < 1").count() == 0
    assert mean == pytest.approx(0.8, abs=0.03) and var == pytest.approx(0.8, abs=0.05)


def test_correlated_columns(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") * -3.0).alias("c"), (F.col("id") % 7).alias("d"), F.lit(1.0).alias("e")
    )
    assert co.correlated_columns(df, ["a", "b", "c", "d", "e"], 0.9) == ["b", "c"]
    assert co.correlated_columns(df, ["a", "b", "c", "d"], 0.9, target="b") == ["c"]
    assert co.correlated_columns(df, ["a", "b", "c", "d"], 0.9, protected=("c",)) == ["b"]


def test_sequential_outliers_depend_on_order(spark):
    rows = [(float(i % 10), float(i % 7)) for i in range(200)] + [(500.0, 400.0), (5.0, 300.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    kept, log = ou.remove_outliers(df, ["a", "b"])
    assert [n for _, n in log] == [1, 1] and kept.count() == 200


def test_distribution_needs_values(spark):
    with pytest.raises(ValueError):
        ou.distribution_report(column(spark, [None], "double"), "x")


def test_strict_normality(spark):
    df = spark.range(4000).select(F.randn(7).alias("x"), F.exp(F.randn(7)).alias("z"))
    assert ou.distribution_report(df, "x", compat=False).first().method == "Z-Score"
    assert ou.distribution_report(df, "z", compat=False).first().method == "IQR"
    assert ou.distribution_report(df.select((F.col("x") + 50).alias("x")), "x").first().method == "IQR"


def test_components(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0 + F.col("id") % 5).alias("b"), (F.col("id") % 11).alias("c"))
    ratios = [r.ratio for r in ou.explained_variance(df, ["a", "b", "c"], 3).orderBy("component").collect()]
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) == pytest.approx(1)
    p = ou.project(df.withColumn("k", F.col("a")), ["a", "b", "c"], 2, ["k"])
    row = p.agg(F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"), F.corr("pc1", "pc2").alias("r")).first()
    assert abs(row.m1) < 1e-6 and abs(row.m2) < 1e-6 and abs(row.r) < 1e-6


def test_missing_share_tiers(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 3, F.col("id")).alias("few"), F.when(F.col("id") >= 10, F.col("id")).alias("some"), F.when(F.col("id") >= 20, F.col("id")).alias("many")
    )
    out = cl.fill_by_missing_share(df)
    assert out.columns == ["few", "some"]
    assert out.agg(F.min("few"), F.min("some")).first() == (3.0, 10.0)
    assert out.where("few = 51.0").count() == 4 and out.where("some = 54.5").count() == 10


def test_mode_ties_are_numeric(spark):
    df = column(spark, [10, 10, 9, 9, None], "int")
    assert cl.modes(df, ["x"]) == {"x": 9.0}


def test_nan_becomes_null(spark):
    df = column(spark, [float("nan"), 1.0, None], "double")
    assert [r.x for r in cl.nan_to_null(df).collect()] == [None, 1.0, None]


def test_negative_zero_is_one_value(spark):
    assert pr.distinct_counts(column(spark, [0.0, -0.0, 1.0], "double"), ["x"]).first().distinct == 2


def test_active_precedence(spark):
    df = spark.createDataFrame([(1, 0), (500, 0), (2, 1), (3, None), (500, None)], "len_id int, is_deleted int")
    assert sorted((r.len_id, r.is_deleted) for r in df.where(fl.active()).collect() if r.is_deleted == 0) == [(1, 0), (500, 0)]
    assert df.where(fl.active()).count() == 3


def test_empty_choices(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        fl.complete_rows(df, "id", [])
    with pytest.raises(ValueError):
        rd.important_columns(spark.createDataFrame([], FEATURE_METADATA_SCHEMA), "loans", (4,))
    with pytest.raises(ValueError):
        cl.impute(df, ["id"], "other")


def test_small_side_is_checked(spark):
    df = spark.range(50)
    assert "strategy=broadcast" in df.join(small_side(df, 100), "id")._jdf.queryExecution().logical().toString()
    assert small_side(df, 10) is df


def test_csv_folder_ignores_other_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1,h2,h3\n1,x\n2,y,z,extra\n")
    (tmp_path / "b.txt").write_text("h1,h2,h3\n9,x,y\n")
    out = rd.read_positional_csv(spark, str(tmp_path), [("id", "int"), ("t", "string"), ("u", "string")])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", None), (2, "y", "z")]


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("values", [
    "case when id % 10 < 6 then 0.0 else id / 1e5 end",  # a hot value beside the wanted rank
    "cast(id % 2 as double)", "0.5", "case when id % 3 = 0 then -1e300 when id % 3 = 1 then 1e-300 else cast(id as double) end",
    "case when id % 7 = 0 then null when id % 7 = 1 then double('nan') else -1.0 * (id % 1000) end",
])
def test_order_statistics_end(spark, values, monkeypatch):
    """Equal to a sort, in a bounded number of rounds, whatever values are frequent."""
    from loantriad.operators import ranks

    rounds, narrow = [], ranks._narrow
    monkeypatch.setattr(ranks, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    df = spark.range(60_000).select(F.expr(values).cast("double").alias("x"))
    plain = sorted(r.x for r in df.collect() if r.x is not None and r.x == r.x)
    n = len(plain)
    wanted = sorted({1, 2, n // 4, n // 2, n // 2 + 1, 6 * n // 10, 6 * n // 10 + 1, n - 1, n})
    got = ranks.order_statistics(df, {"x": wanted}, accuracy=100, most=50)["x"]
    assert got == {r: plain[r - 1] for r in wanted}
    assert len(rounds) <= 64 + 17
