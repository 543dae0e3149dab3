"""Queries for descriptive statistics, correlation, outliers, distribution tests, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantriad.catalog.registry import query
from loantriad.operators import correlation as co
from loantriad.operators import outliers as ou
from loantriad.operators import profile as pr
from loantriad.plans.loans import labelled_loans, loans, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LOAN = ["loan_amount", "loan_rate", "duration_years", "installment_number", "monthly_income"]
LABELS = {"l_quantity": "Quantity", "l_extendedprice": "Extended price", "l_discount": "Discount", "l_tax": "Tax"}


def stacked(parts) -> str:
    return "\nunion all ".join(parts)


def line(spark, folder):
    return table(spark, folder, "lineitem")


def clean(column, digits):
    """Rounded, and never negative zero."""
    return (F.round(column, digits) + F.lit(0.0)).alias(column)


AGG1 = ["mean", "sd", "variance", "min", "max", "skewness", "kurtosis"]


def agg1_sql(col: str, label: str, source: str) -> str:
    return f"""select '{label}' as "column", count({col}) as n, round(avg({col}), 4) + 0.0 as mean, round(stddev_samp({col}), 4) + 0.0 as sd,
        round(var_samp({col}), 3) + 0.0 as variance, round(min({col}), 4)::double + 0.0 as min, round(max({col}), 4)::double + 0.0 as max,
        round(skewness({col}), 4) + 0.0 as skewness, round(kurtosis({col}), 4) + 0.0 as kurtosis from {source}"""


@query("agg1_column_statistics", stacked(agg1_sql(c, LABELS[c], "lineitem") for c in LINE))
def agg1(spark, folder):
    out = pr.moments(line(spark, folder), LINE, LABELS)
    return out.select("column", "n", *[clean(c, 3 if c == "variance" else 4) for c in AGG1])


@query(
    "agg1_column_statistics_where",
    agg1_sql("l_extendedprice", "l_extendedprice", "lineitem where l_returnflag = 'R' and l_quantity > 10"),
)
def agg1_where(spark, folder):
    out = pr.moments(line(spark, folder).where("l_returnflag = 'R' and l_quantity > 10"), ["l_extendedprice"])
    return out.select("column", "n", *[clean(c, 3 if c == "variance" else 4) for c in AGG1])


DESC = ["mean", "sd", "cv", "median", "min", "max", "range", "iqr", "skew", "kurt", "missing_pct"]


def agg2_sql(c: str) -> str:
    return f"""select '{c}' as "column", round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as sd, round(stddev_samp({c}) / avg({c}), 2) as cv,
      round(quantile_cont({c}::double, 0.5), 2) as median, round(min({c})::double, 2) as min, round(max({c})::double, 2) as max,
      round((max({c}) - min({c}))::double, 2) as range, round(quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25), 2) as iqr,
      round(skewness({c}), 2) as skew, round(kurtosis({c}), 2) as kurt, round(100.0::double * (count(*) - count({c})) / count(*), 2) as missing_pct,
      count(distinct {c}) as "distinct" from loans"""


@query("agg2_describe", stacked(agg2_sql(c) for c in LOAN), loans=True)
def agg2(spark, folder):
    return pr.describe(loans(spark, folder), LOAN)


@query(
    "agg3_attribute_stats",
    stacked(
        f"""select '{c}' as "column", count(*) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd, round(var_samp({c}), 2) as variance,
        min({c})::double as min, max({c})::double as max, round((max({c}) - min({c}))::double, 4) as range, count(*) - count({c}) as missing,
        count(distinct {c}) as "distinct" from loans"""
        for c in LOAN
    ),
    loans=True,
)
def agg3(spark, folder):
    out = pr.attribute_stats(loans(spark, folder), LOAN)
    return out.select(
        "column", "count", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("variance", 2).alias("variance"),
        "min", "max", F.round("range", 4).alias("range"), "missing", "distinct",
    )


@query(
    "agg4_mixed_summary",
    """select 'loan_amount' as "column", count(distinct loan_amount) as "distinct", count(*) - count(loan_amount) as missing, null as min, null as max,
      round(max(loan_amount) - min(loan_amount), 2) as range, round(avg(loan_amount), 2) as mean, null as mean_date,
      round(var_samp(loan_amount) / 1e6::double, 2) as variance, round(stddev_samp(loan_amount), 2) as sd from loans
    union all select 'loan_date', count(distinct loan_date), count(*) - count(loan_date), strftime(min(loan_date), '%Y-%m-%d'), strftime(max(loan_date), '%Y-%m-%d'),
      (max(loan_date)::date - min(loan_date)::date)::double, null,
      strftime(date '1970-01-01' + floor(avg(loan_date::date - date '1970-01-01'))::int, '%Y-%m-%d'), null, null from loans
    union all select 'loan_purpose', count(distinct loan_purpose), count(*) - count(loan_purpose), min(loan_purpose), max(loan_purpose), null, null, null, null, null from loans
    union all select 'status', count(distinct status), count(*) - count(status), min(status), max(status), null, null, null, null, null from loans""",
    loans=True,
)
def agg4(spark, folder):
    out = pr.mixed_summary(loans(spark, folder), ["loan_amount", "loan_date", "loan_purpose", "status"])
    text = F.col("column") != "loan_amount"  # numbers as text are engine specific; their range is checked instead
    return out.select(
        "column", "distinct", "missing", F.when(text, F.col("min")).alias("min"), F.when(text, F.col("max")).alias("max"),
        F.round("range", 2).alias("range"), F.round("mean", 2).alias("mean"), "mean_date",
        F.round(F.col("variance") / 1e6, 2).alias("variance"), F.round("sd", 2).alias("sd"),
    )


@query("agg5_value_counts", "select status, count(*) as n from loans group by status", loans=True)
def agg5(spark, folder):
    return pr.value_counts(loans(spark, folder), "status")


@query(
    "agg6_missing_report",
    """select 'monthly_income' as "column", count(*) - count(monthly_income) as missing,
        round(100.0::double * (count(*) - count(monthly_income)) / count(*), 2) as missing_pct from loans
    union all select 'status', count(*) - count(status), round(100.0::double * (count(*) - count(status)) / count(*), 2) from loans""",
    loans=True,
)
def agg6(spark, folder):
    return pr.missing_report(loans(spark, folder))


MEDIAN = {"lineitem": ["l_quantity", "l_extendedprice"], "part": ["p_retailprice"], "events": ["value"]}


@query(
    "agg7_median",
    stacked(f"select '{c}' as \"column\", round(median({c}::double), 6) as median from {t}" for t, cs in MEDIAN.items() for c in cs),
)
def agg7(spark, folder):
    rows = []
    for name, columns in MEDIAN.items():
        marks = pr.percentiles(table(spark, folder, name), columns, [0.5])
        rows += [(c, marks[c][0.5]) for c in columns]
    out = spark.createDataFrame(rows, "column string, median double")
    return out.select("column", F.round("median", 6).alias("median"))


@query(
    "agg7_median_nan",
    """select 'l_extendedprice' as "column", round(median(case when l_linenumber < 3 then null else l_extendedprice end), 6) as median from lineitem
    union all select 'l_quantity', round(median(case when l_linenumber < 6 then null else l_quantity end), 6) from lineitem""",
)
def agg7_nan(spark, folder):
    """Not-a-number is missing, also where most values are."""
    items = table(spark, folder, "lineitem")
    gone = {"l_extendedprice": 3, "l_quantity": 6}
    items = items.select(*[F.when(F.col("l_linenumber") < n, F.lit(float("nan"))).otherwise(F.col(c).cast("double")).alias(c) for c, n in gone.items()])
    marks = pr.percentiles(items, list(gone), [0.5])
    out = spark.createDataFrame([(c, marks[c][0.5]) for c in gone], "column string, median double")
    return out.select("column", F.round("median", 6).alias("median"))


SEVEN = ["loan_amount", "loan_rate", "duration_years", "installment_number", "monthly_income", "p_default", "branch_code"]


@query(
    "agg8_top_variance",
    "select * from ("
    + stacked(f"select '{c}' as \"column\", round(var_samp({c}), 3) as variance from loans" for c in SEVEN)
    + ') order by variance desc, "column" limit 5',
    loans=True,
)
def agg8(spark, folder):
    out = pr.top_variance(loans(spark, folder), SEVEN, 5)
    return out.select("column", F.round("variance", 3).alias("variance"))


def hist_sql(column: str, bins: int, source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""select {keys}bin, round(lo + bin * w, 4) as start, n, round(n / (sum(n) over ({part}))::double, 6) as share,
      round(n / (sum(n) over ({part}))::double / w, 8) as density
    from (select {keys}lo, w, least(floor(({column} - lo) / w), {bins - 1})::int as bin, count(*) as n
      from {source}, (select min({column}) as lo, (max({column}) - min({column})) / {bins}::double as w from {source}) r
      where {column} is not null group by all)"""


def shown(hist, *keys):
    return hist.select(
        *keys, "bin", F.round("start", 4).alias("start"), "n", F.round("share", 6).alias("share"), F.round("density", 8).alias("density")
    )


@query("agg9_histogram", hist_sql("loan_amount", 20, "loans"), loans=True)
def agg9(spark, folder):
    return shown(pr.histogram(loans(spark, folder), "loan_amount", 20))


@query("agg9_histogram_by_class", hist_sql("p_default", 20, "scored", "y"), loans=True)
def agg9_class(spark, folder):
    return shown(pr.histogram(labelled_loans(spark, folder), "p_default", 20, ["y"]), "y")


@query("agg9_histogram_probability", hist_sql("p_default", 100, "scored"), loans=True)
def agg9_probability(spark, folder):
    return shown(pr.histogram(labelled_loans(spark, folder), "p_default", 100))


@query(
    "agg9_histogram_around_removal",
    f"""with a as (select e.value from events e, (select q1 - 1.5::double * (q3 - q1) as lower, q3 + 1.5::double * (q3 - q1) as upper from
        (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)) f where value >= lower and value <= upper)
    select 'before' as stage, * from ({hist_sql('value', 20, 'events')}) union all select 'after', * from ({hist_sql('value', 20, 'a')})""",
)
def agg9_removal(spark, folder):
    """Distribution before and after values outside the (linear) quartile fences are removed."""
    df = table(spark, folder, "events").select("value")
    fence = ou.iqr_fences(df, ["value"], method="linear")[0]
    parts = {"before": df, "after": df.where(~ou.is_outlier(fence))}
    shapes = [shown(pr.histogram(d, "value", 20)).withColumn("stage", F.lit(n)) for n, d in parts.items()]
    return shapes[0].unionByName(shapes[1])


PAIRS = co.pair_list(LOAN + ["branch_code"])


@query(
    "cor1_pearson_pairs",
    stacked(f"select '{a}' as col1, '{b}' as col2, round(corr({a}, {b}), 6) + 0.0 as pearson from loans" for a, b in PAIRS),
    loans=True,
)
def cor1(spark, folder):
    return co.pearson_pairs(loans(spark, folder), LOAN + ["branch_code"]).select("col1", "col2", clean("pearson", 6))


@query(
    "cor2_matrix",
    stacked(
        f"select '{a}' as \"column\", " + ", ".join("1.0::double as " + b if a == b else f"round(corr({a}, {b}), 2) + 0.0 as {b}" for b in LINE) + " from lineitem"
        for a in LINE
    ),
)
def cor2(spark, folder):
    out = co.correlation_matrix(line(spark, folder), LINE)
    return out.select("column", *[(F.col(c) + F.lit(0.0)).alias(c) for c in LINE])


@query(
    "cor3_drop_correlated",
    """select case when abs(corr(loan_amount, lam_np)) > 0.7 then 'dropped' else 'kept' end as lam_np,
        case when abs(corr(loan_amount, lam_pn)) > 0.7 or abs(corr(lam_np, lam_pn)) > 0.7 then 'dropped' else 'kept' end as lam_pn,
        case when abs(corr(loan_amount, loan_rate)) > 0.7 or abs(corr(lam_np, loan_rate)) > 0.7 or abs(corr(lam_pn, loan_rate)) > 0.7 then 'dropped' else 'kept' end as loan_rate,
        case when abs(corr(loan_amount, installment_number)) > 0.7 or abs(corr(lam_np, installment_number)) > 0.7 or abs(corr(lam_pn, installment_number)) > 0.7
          or abs(corr(loan_rate, installment_number)) > 0.7 then 'dropped' else 'kept' end as installment_number,
        round(sum(loan_amount), 2) as total from scored""",
    loans=True,
)
def cor3(spark, folder):
    """Which of four columns survive next to the amount, with the label and the key protected."""
    from loantriad.operators.threeway import loss_columns

    df = loss_columns(labelled_loans(spark, folder)).select("loan_id", "loan_amount", "lam_np", "lam_pn", "loan_rate", "installment_number", "y")
    numbers = [c for c in df.columns if c != "loan_id"]
    left = co.drop_correlated(df, numbers, 0.7, target="y")
    state = {c: F.lit("kept" if c in left.columns else "dropped") for c in ("lam_np", "lam_pn", "loan_rate", "installment_number")}
    return left.agg(F.round(F.sum("loan_amount"), 2).alias("total")).withColumns(state)


def legacy(column: str, p: float, alias: str) -> str:
    """(n + 1) percentile from ranked values x with rank rn and size n."""
    spot = f"least(greatest({p}::double * (n + 1), 1), n)"
    return f"""(max(x) filter (where rn = floor({spot})) + ({spot_part(p)}) * (max(x) filter (where rn = least(floor({spot}) + 1, n))
        - max(x) filter (where rn = floor({spot})))) as {alias}"""


def spot_part(p: float) -> str:
    return f"least(greatest({p}::double * (max(n) + 1), 1), max(n)) - floor(least(greatest({p}::double * (max(n) + 1), 1), max(n)))"


def fence_sql(column: str, source: str) -> str:
    return f"""(select q1, q3, q1 - 1.5::double * (q3 - q1) as lower, q3 + 1.5::double * (q3 - q1) as upper from
      (select {legacy(column, 0.25, 'q1')}, {legacy(column, 0.75, 'q3')}
       from (select {column}::double as x, row_number() over (order by {column}) as rn, count(*) over () as n from {source} where {column} is not null)))"""


@query(
    "out1_iqr_fences",
    stacked(
        f"""select '{c}' as "column", round(q1, 4) as q1, round(q3, 4) as q3, round(lower, 4) as lower, round(upper, 4) as upper,
          (select count(*) from lineitem where {c} < lower or {c} > upper) as removed,
          (select round(avg({c}), 4) from lineitem) as mean, (select round(skewness({c}), 4) + 0.0 from lineitem) as skewness from {fence_sql(c, 'lineitem')}"""
        for c in ("l_extendedprice", "l_quantity")
    ),
)
def out1(spark, folder):
    out = ou.outlier_report(line(spark, folder), ["l_extendedprice", "l_quantity"])
    return out.select(
        "column", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")], "removed", F.round("mean", 4).alias("mean"), clean("skewness", 4)
    )


@query(
    "out1_iqr_fences_nan",
    f"""with holes as (select case when l_linenumber = 2 then null else l_extendedprice end as l_extendedprice from lineitem)
    select 'l_extendedprice' as "column", round(q1, 4) as q1, round(q3, 4) as q3,
      (select count(*) from holes where l_extendedprice < lower or l_extendedprice > upper) as removed,
      (select round(avg(l_extendedprice), 4) from holes) as mean from {fence_sql('l_extendedprice', 'holes')}""",
)
def out1_nan(spark, folder):
    x = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_extendedprice").cast("double"))
    out = ou.outlier_report(table(spark, folder, "lineitem").select(x.alias("l_extendedprice")), ["l_extendedprice"])
    return out.select("column", *[F.round(c, 4).alias(c) for c in ("q1", "q3")], "removed", F.round("mean", 4).alias("mean"))


@query(
    "out1_soft_delete",
    f"""select event_type, cast(value < lower or value > upper as int) as is_deleted, count(*) as n
    from events, {fence_sql('value', 'events')} f group by 1, 2""",
)
def out1_flag(spark, folder):
    return ou.flag_outliers(table(spark, folder, "events"), ["value"]).groupBy("event_type", "is_deleted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "out2_sequential",
    f"""with a as (select l.* from lineitem l, {fence_sql('l_extendedprice', 'lineitem')} f where not (l_extendedprice < lower or l_extendedprice > upper)),
    b as (select a.* from a, {fence_sql('l_tax', 'a')} f where not (l_tax < lower or l_tax > upper)),
    c as (select b.* from b, {fence_sql('l_quantity', 'b')} f where not (l_quantity < lower or l_quantity > upper))
    select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as total from c group by 1""",
)
def out2(spark, folder):
    kept, _ = ou.remove_outliers(line(spark, folder), ["l_extendedprice", "l_tax", "l_quantity"])
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "out2_sequential_events",
    f"""with a as (select e.* from events e, {fence_sql('value', 'events')} f where not (value < lower or value > upper)),
    b as (select a.* from a, {fence_sql('user_id', 'a')} f where not (user_id < lower or user_id > upper))
    select event_type, count(*) as n from b group by 1""",
)
def out2_events(spark, folder):
    kept, _ = ou.remove_outliers(table(spark, folder, "events"), ["value", "user_id"])
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "out3_zscore",
    """select event_id, value from events, (select avg(value) as m, stddev_samp(value) as s from events) t where abs((value - m) / s) > 3""",
)
def out3(spark, folder):
    return ou.zscore_outliers(table(spark, folder, "events"), "value").select("event_id", "value")


KS = """, v as (select (loan_amount - m) / s as x, 1 as l, 0 as r from loans, (select avg(loan_amount) as m, stddev_samp(loan_amount) as s from loans) t
      union all select loan_amount, 0, 1 from loans),
    c as (select x, sum(l) as l, sum(r) as r from v group by x),
    w as (select sum(l) over (order by x) as cl, sum(r) over (order by x) as cr from c),
    d as (select max(abs(cl / (select sum(l) from c)::double - cr / (select sum(r) from c)::double)) as d from w)
"""


@query(
    "tst1_distribution",
    KS
    + """select *, case when is_normal then 'Z-Score' else 'IQR' end as method from (
      select *, abs(skewness) < 1 and abs(kurtosis - 3) < 1 and ks_p > 0.05 as is_normal from (
      select 'loan_amount' as "column", count(*) as n, round(avg(loan_amount), 2) as mean, round(stddev_samp(loan_amount), 2) as sd,
      round(skewness(loan_amount), 4) as skewness, round(kurtosis(loan_amount), 4) as kurtosis, round((select d from d), 6) as ks_d,
      round((select least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (case when j % 2 = 1 then 1.0::double else -1.0::double end)
        * exp(-2.0::double * j * j * q.d * q.d * q.n / 2.0::double)))))
        from (select d, (select count(*) from loans) as n from d) q), 6) as ks_p
      from loans))""",
    loans=True,
)
def tst1(spark, folder):
    out = ou.distribution_report(loans(spark, folder), "loan_amount")
    return out.select(
        "column", "n", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), F.round("skewness", 4).alias("skewness"),
        F.round("kurtosis", 4).alias("kurtosis"), F.round("ks_d", 6).alias("ks_d"),
        F.round("ks_p", 6).alias("ks_p"), "is_normal", "method",
    )


@query("tst1_distribution_normal")
def tst1_normal(spark, folder):
    """The strict reading: values against the fitted normal, excess kurtosis against 0."""
    return ou.distribution_report(table(spark, folder, "events"), "value", compat=False)


@query("pca1_explained_variance")
def pca1(spark, folder):
    df = loans(spark, folder).na.fill(0.0, ["monthly_income"])
    return ou.explained_variance(df, LOAN, 3)


@query(
    "pca1_two_columns",
    """, s as (select var_samp(loan_amount) as a, var_samp(monthly_income) as b, covar_samp(loan_amount, monthly_income) as c
      from loans where monthly_income is not null),
    e as (select a + b as total, sqrt(((a - b) / 2) * ((a - b) / 2) + c * c) as gap from s)
    select 1 as component, round((total / 2 + gap) / total, 6) as ratio, round((total / 2 + gap) / total, 6) as cumulative from e
    union all select 2, round((total / 2 - gap) / total, 6), 1.0::double from e""",
    loans=True,
)
def pca1_two(spark, folder):
    """Two columns have a closed form; loans without an income have no place in the plane and are left out."""
    out = ou.explained_variance(loans(spark, folder), ["loan_amount", "monthly_income"], 2)
    return out.select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


@query("pca1_projection")
def pca1_projection(spark, folder):
    df = loans(spark, folder).na.fill(0.0, ["monthly_income"])
    return ou.project(df, LOAN, 2, ["loan_id"])
