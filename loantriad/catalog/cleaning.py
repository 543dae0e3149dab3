"""Queries for column cleaning and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loantriad.catalog.registry import query
from loantriad.operators import clean as cl
from loantriad.operators import encode as en
from loantriad.operators import profile as pr
from loantriad.plans.loans import loans, table


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})




@query("cln1_drop_empty", "select loan_id, monthly_income from loans", loans=True)
def cln1(spark, folder):
    df = loans(spark, folder).select("loan_id", "monthly_income", F.lit(None).cast("double").alias("nothing"))
    return cl.drop_empty_columns(df)


@query("cln2_drop_sparse", "select loan_id, case when loan_id % 4 = 0 then loan_amount end as quarter from loans", loans=True)
def cln2(spark, folder):
    df = loans(spark, folder).select(
        "loan_id", F.when(F.col("loan_id") % 10 == 0, F.col("loan_amount")).alias("tenth"), F.when(F.col("loan_id") % 4 == 0, F.col("loan_amount")).alias("quarter")
    )
    return cl.drop_sparse_columns(df)


@query("cln3_drop_constant", "select loan_id, status from loans", loans=True)
def cln3(spark, folder):
    df = loans(spark, folder).select("loan_id", "status", F.lit("IR").alias("country"), F.when(F.col("loan_id") % 2 == 0, 1).alias("seen"))
    return cl.drop_constant_columns(df)


@query("cln4_low_variance", "select l_orderkey, l_linenumber, round(l_discount, 2) + 0.0 as l_discount from lineitem")
def cln4(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", (F.col("l_tax") / 10).alias("small"), F.lit(3.0).alias("flat"))
    return rounded(cl.drop_low_variance(df), 2, "l_discount")


@query(
    "cln5_by_missing_share",
    """, t as (select loan_id, monthly_income, case when loan_id % 10 = 0 then null else loan_amount end as amount, status from loans)
    select loan_id, round(coalesce(monthly_income, (select avg(monthly_income) from t)), 4) as monthly_income,
      round(coalesce(amount, (select median(amount) from t)), 4) as amount,
      coalesce(status, (select status from t where status is not null group by status order by count(*) desc, status limit 1)) as status from t""",
    loans=True,
)
def cln5(spark, folder):
    df = loans(spark, folder).select(
        "loan_id", "monthly_income", F.when(F.col("loan_id") % 10 != 0, F.col("loan_amount")).alias("amount"), "status",
        F.when(F.col("loan_id") % 2 == 0, F.col("loan_rate")).alias("half"),
    )
    return rounded(cl.fill_by_missing_share(df), 4, "monthly_income", "amount")


@query(
    "cln6_impute",
    """, t as (select loan_id, monthly_income as x, case when loan_id % 3 = 0 then null else duration_years end as d from loans)
    select loan_id, round(coalesce(x, (select avg(x) from t)), 4) as by_mean, round(coalesce(x, (select median(x) from t)), 4) as by_median,
      coalesce(d, (select d from t where d is not null group by d order by count(*) desc, d limit 1))::double as by_mode from t""",
    loans=True,
)
def cln6(spark, folder):
    x = F.col("monthly_income")
    df = loans(spark, folder).select(
        "loan_id", x.alias("by_mean"), x.alias("by_median"), F.when(F.col("loan_id") % 3 != 0, F.col("duration_years")).alias("by_mode")
    )
    out = cl.impute(df, ["by_mean"], "mean")
    out = cl.impute(out, ["by_median"], "median")
    return rounded(cl.impute(out, ["by_mode"], "most_frequent"), 4, "by_mean", "by_median")


@query(
    "cln7_mean_or_mode",
    """select loan_id::double as loan_id, round(coalesce(monthly_income, (select avg(monthly_income) from loans)), 4) as monthly_income,
      coalesce(status, (select status from loans where status is not null group by status order by count(*) desc, status limit 1)) as status from loans""",
    loans=True,
)
def cln7(spark, folder):
    return rounded(cl.fill_mean_or_mode(loans(spark, folder).select("loan_id", "monthly_income", "status")), 4, "monthly_income")


@query(
    "cln8_coerce",
    """, t as (select loan_id, case when loan_id % 13 = 0 then null else loan_amount end as amount, case when loan_id % 7 = 0 then null else duration_years end as years from loans)
    select loan_id, round(coalesce(amount, (select avg(amount) from t)), 4) as amount, coalesce(years, 1)::double as years, 1.0::double as absent from t""",
    loans=True,
)
def cln8(spark, folder):
    df = loans(spark, folder).select(
        "loan_id", F.when(F.col("loan_id") % 13 == 0, "bad").otherwise(F.col("loan_amount").cast("string")).alias("amount"),
        F.when(F.col("loan_id") % 7 == 0, "?").otherwise(F.col("duration_years").cast("string")).alias("years"),
    )
    return rounded(cl.coerce_numbers(df, ["amount"], {"years": 1.0, "absent": 1.0}), 4, "amount")


@query(
    "cln9_convert",
    """, c as (select v, row_number() over (order by v) - 1 as code from (select distinct coalesce(status, 'None') as v from loans)),
    k as (select v, row_number() over (order by v) - 1 as code from (select distinct contract_type as v from loans))
    select loan_id, (loan_date::date - date '2000-01-01')::int as loan_date, c.code::int as status, k.code::int as contract_type, round(loan_rate::double, 2) as rate_text
    from loans join c on c.v = coalesce(status, 'None') join k on k.v = contract_type""",
    loans=True,
)
def cln9(spark, folder):
    df = loans(spark, folder).select("loan_id", "loan_date", "status", "contract_type", F.col("loan_rate").cast("string").alias("rate_text"))
    return cl.convert_columns(df)


@query(
    "cln9_convert_seconds",
    "select loan_id, epoch(loan_date)::bigint as loan_date from loans",
    loans=True,
)
def cln9_seconds(spark, folder):
    return cl.convert_columns(loans(spark, folder).select("loan_id", "loan_date"), unit="seconds")


@query(
    "cln10_standardize",
    """select loan_id, round((loan_amount - avg(loan_amount) over ()) / stddev_pop(loan_amount) over (), 6) + 0.0 as loan_amount,
      round((monthly_income - avg(monthly_income) over ()) / stddev_pop(monthly_income) over (), 6) + 0.0 as monthly_income from loans""",
    loans=True,
)
def cln10(spark, folder):
    df = loans(spark, folder).select("loan_id", "loan_amount", "monthly_income")
    return rounded(cl.standardize(df, ("loan_id",)), 6, "loan_amount", "monthly_income")


@query(
    "cln10_fit_transform",
    """, s as (select avg(loan_amount) as m, stddev_pop(loan_amount) as sd from loans where loan_id % 5 <> 0)
    select loan_id, round((loan_amount - m) / sd, 6) + 0.0 as loan_amount from loans, s where loan_id % 5 = 0""",
    loans=True,
)
def cln10_fit(spark, folder):
    """Statistics fitted on the training part, applied to the rest."""
    df = loans(spark, folder).select("loan_id", "loan_amount")
    fitted = cl.scale_stats(df.where(F.col("loan_id") % 5 != 0), ["loan_amount"])
    return rounded(cl.apply_scale(df.where(F.col("loan_id") % 5 == 0), fitted), 6, "loan_amount")


@query(
    "cln11_standardize_if_spread",
    """select event_id, round((value - avg(value) over ()) / stddev_samp(value) over (), 6) + 0.0 as value,
      round((shifted - avg(shifted) over ()) / stddev_samp(shifted) over (), 6) + 0.0 as shifted from (select event_id, value, value - 100 as shifted from events)""",
)
def cln11(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", (F.col("value") - 100).alias("shifted"))
    return rounded(cl.standardize_if_spread(df, ["value", "shifted"]), 6, "value", "shifted")


QUALITY = {"monthly_income": "= 0", "loan_rate": "= 0", "installment_number": "= 0", "status": None, "loan_purpose": None}


@query(
    "cln12_quality_report",
    "\nunion all ".join(
        f"""select '{c}' as "column", count(*) as total_rows, count(*) filter (where {c} is null or {f'{c} {r}' if r else f"trim({c}) = ''"}) as useless_count,
        round(100.0::double * count(*) filter (where {c} is null or {f'{c} {r}' if r else f"trim({c}) = ''"}) / count(*), 2) as useless_percentage from loans"""
        for c, r in QUALITY.items()
    ),
    loans=True,
)
def cln12(spark, folder):
    return pr.useless_report(loans(spark, folder), list(QUALITY))


@query(
    "enc1_label_codes",
    """, c as (select v, row_number() over (order by v) - 1 as code from (select distinct coalesce(status, 'None') as v from loans))
    select loan_id, c.code::int as status from loans join c on c.v = coalesce(status, 'None')""",
    loans=True,
)
def enc1(spark, folder):
    return en.encode_labels(loans(spark, folder).select("loan_id", "status"), ["status"])


@query(
    "enc2_factorize",
    """, c as (select v, row_number() over (order by first_at) - 1 as code from (select status as v, min(loan_id) as first_at from loans where status is not null group by 1))
    select loan_id, status, coalesce(c.code, -1)::int as code from loans left join c on c.v = status""",
    loans=True,
)
def enc2(spark, folder):
    return en.factorize(loans(spark, folder).select("loan_id", "status"), "status", "loan_id", "code")


@query(
    "enc3_one_hot",
    """select loan_id, coalesce(status = 'active', false)::int as status_active, coalesce(status = 'doubtful', false)::int as status_doubtful,
      coalesce(status = 'overdue', false)::int as status_overdue from loans""",
    loans=True,
)
def enc3(spark, folder):
    return en.one_hot(loans(spark, folder).select("loan_id", "status"), ["status"])


@query(
    "enc3_one_hot_vector",
    """, a as (select v, row_number() over (order by v) - 2 as place from (select distinct customer_id::varchar as v from loans)),
    b as (select v, (select count(*) from a) - 1 + row_number() over (order by v) - 2 as place, row_number() over (order by v) as k
        from (select distinct status as v from loans where status is not null))
    select loan_id, concat_ws(',', case when a.place >= 0 then a.place + 1 end, case when b.k > 1 then b.place + 1 end) as places
    from loans join a on a.v = customer_id::varchar left join b on b.v = status""",
    loans=True,
)
def enc3_vector(spark, folder):
    """A place for every customer and status behind one number that is zero; the places that are filled."""
    df = loans(spark, folder).select("loan_id", "customer_id", "status", F.lit(0.0).alias("zero"))
    out = en.one_hot_vector(df, ["customer_id", "status"], ["zero"])
    return out.select("loan_id", F.array_join(en.filled_places("features"), ",").alias("places"))


@query(
    "enc4_nominal_index",
    """, c as (select v, row_number() over (order by v) - 1 as code from (select distinct status as v from loans where status is not null))
    select loan_id, c.code::int as class_index, case when loan_id % 13 = 0 then null else loan_amount end as amount from loans left join c on c.v = status""",
    loans=True,
)
def enc4(spark, folder):
    text = F.when(F.col("loan_id") % 13 == 0, "bad").otherwise(F.col("loan_amount").cast("string"))
    df = loans(spark, folder).select("loan_id", F.col("status").alias("class_index"), text.try_cast("double").alias("amount"))
    return en.encode_labels(df, ["class_index"], null_text=None)
