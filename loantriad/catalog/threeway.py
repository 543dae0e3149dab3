"""Queries for losses, thresholds, regions, the scale search and the decision reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.catalog.registry import query
from loantriad.operators import certify as ce
from loantriad.operators import search as sr
from loantriad.operators import threeway as tw
from loantriad.session import settle
from loantriad.plans.loans import labelled_loans, loans

U, V = 0.3, 0.4


def priced(spark: SparkSession, folder: str) -> DataFrame:
    return tw.loss_columns(labelled_loans(spark, folder))


# One decided loan table for the checks, at the same scales as ``decided`` below.
DECIDED = """, marked as (
select *, coalesce((lam_pn - v * lam_pn) / nullif((lam_pn - v * lam_pn) + u * lam_np, 0), 1.0) as alpha,
       coalesce(v * lam_pn / nullif(v * lam_pn + (lam_np - u * lam_np), 0), 0.0) as beta
from scored, (select cast(0.3 as double) as u, cast(0.4 as double) as v) s),
decided as (
select *, case when p_default >= alpha then 'POS' when p_default <= beta then 'NEG' else 'BND' end as region from marked)
"""


def decided(spark: SparkSession, folder: str) -> DataFrame:
    return tw.decide(priced(spark, folder), U, V)


@query(
    "flagship_regions",
    DECIDED
    + """select region, count(*) as n, cast(sum(y) as bigint) as defaults,
    round(sum(case region when 'POS' then case when y = 0 then lam_pn else 0 end
        when 'NEG' then case when y = 1 then lam_np else 0 end
        else case when y = 1 then u * lam_np else v * lam_pn end end), 2) as total_cost
    from decided group by region""",
    loans=True,
)
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    cost = tw.realised_cost(
        F.col("region"), F.col("y"), F.col("lam_pn"), F.col("lam_np"), F.lit(U), F.lit(V)
    )
    return decided(spark, folder).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("defaults"),
        F.round(F.sum(cost), 2).alias("total_cost"),
    )


@query(
    "twd1_loss_years",
    "select loan_id, round(lam_pn, 6) as lam_pn, round(lam_np, 6) as lam_np from scored",
    loans=True,
)
def twd1_years(spark, folder):
    return priced(spark, folder).select("loan_id", F.round("lam_pn", 6).alias("lam_pn"), F.round("lam_np", 6).alias("lam_np"))


@query(
    "twd1_loss_variants",
    """select 'amount' as variant, round(sum(monthly_income), 2) as lam_pn, round(sum(loan_amount + monthly_income), 2) as lam_np from loans
    union all select 'product', round(sum(coalesce(loan_rate, 0) * coalesce(loan_amount, 0)), 2),
        round(sum(coalesce(loan_amount, 0) + coalesce(loan_rate, 0) * coalesce(loan_amount, 0)), 2) from loans
    union all select 'rate', round(sum(coalesce(loan_rate, 0)), 2), round(sum(coalesce(loan_amount, 0) + coalesce(loan_rate, 0)), 2) from loans""",
    loans=True,
)
def twd1_variants(spark, folder):
    base = loans(spark, folder)
    kinds = {
        "amount": tw.loss_columns(base, "amount", interest="monthly_income"),
        "product": tw.loss_columns(base, "product"),
        "rate": tw.loss_columns(base, "rate"),
    }
    out = None
    for name, df in kinds.items():
        row = df.agg(F.round(F.sum("lam_pn"), 2).alias("lam_pn"), F.round(F.sum("lam_np"), 2).alias("lam_np"))
        row = row.select(F.lit(name).alias("variant"), "lam_pn", "lam_np")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "twd2_thresholds",
    DECIDED + "select loan_id, round(alpha, 6) as alpha, round(beta, 6) as beta, alpha >= beta as ordered from decided",
    loans=True,
)
def twd2(spark, folder):
    return decided(spark, folder).select(
        "loan_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"),
        (F.col("alpha") >= F.col("beta")).alias("ordered"),
    )


@query(
    "twd2_thresholds_lifted",
    """, t as (select loan_id,
        coalesce((lam_pn - 0.8::double * lam_pn) / nullif((lam_pn - 0.8::double * lam_pn) + 0.7::double * lam_np, 0), 1.0) as a,
        coalesce(0.8::double * lam_pn / nullif(0.8::double * lam_pn + (lam_np - 0.7::double * lam_np), 0), 0.0) as b from scored)
    select loan_id, round(greatest(a, b), 6) as alpha, round(b, 6) as beta from t""",
    loans=True,
)
def twd2_lifted(spark, folder):
    out = tw.with_thresholds(priced(spark, folder), 0.7, 0.8, lift=True)
    return out.select("loan_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


@query("twd3_region", DECIDED + "select loan_id, region from decided", loans=True)
def twd3(spark, folder):
    return decided(spark, folder).select("loan_id", "region")


@query(
    "twd3_region_fixed",
    """select case when p_default >= cast(0.7 as double) then 'POS' when p_default <= cast(0.3 as double) then 'NEG' else 'BND' end as region,
    count(*) as n from scored group by 1""",
    loans=True,
)
def twd3_fixed(spark, folder):
    where = tw.fixed_region(F.col("p_default")).alias("region")
    return labelled_loans(spark, folder).groupBy(where).agg(F.count(F.lit(1)).alias("n"))


@query(
    "twd4_expected_cost",
    DECIDED
    + """select loan_purpose, region, round(sum(case region when 'POS' then lam_pn * (1 - p_default) when 'NEG' then lam_np * p_default
        else u * lam_np * p_default + v * lam_pn * (1 - p_default) end), 2) as cost from decided group by 1, 2""",
    loans=True,
)
def twd4(spark, folder):
    cost = tw.expected_cost(F.col("region"), F.col("p_default"), F.col("lam_pn"), F.col("lam_np"), F.lit(U), F.lit(V))
    return decided(spark, folder).groupBy("loan_purpose", "region").agg(F.round(F.sum(cost), 2).alias("cost"))


@query(
    "twd5_realised_cost",
    DECIDED
    + """select loan_id, round(case region when 'POS' then case when y = 0 then lam_pn else 0.0 end
        when 'NEG' then case when y = 1 then lam_np else 0.0 end
        else case when y = 1 then u * lam_np else v * lam_pn end end, 7) as cost from decided""",
    loans=True,
)
def twd5(spark, folder):
    cost = tw.realised_cost(F.col("region"), F.col("y"), F.col("lam_pn"), F.col("lam_np"), F.lit(U), F.lit(V))
    return decided(spark, folder).select("loan_id", F.round(cost, 7).alias("cost"))


@query(
    "twd6_binary_cost",
    """, d as (select *, cast(p_default >= cast(0.5 as double) as int) as pred from scored)
    select loan_purpose,
      round(sum(case when pred = 1 and y = 0 then lam_pn when pred = 0 and y = 1 then lam_np else 0.0 end), 2) as cost_loan,
      round(sum(case when pred = 1 and y = 0 then 1.0::double when pred = 0 and y = 1 then 5.0::double else 0.0 end), 2) as cost_fixed
    from d group by loan_purpose""",
    loans=True,
)
def twd6(spark, folder):
    pred = (F.col("p_default") >= 0.5).cast("int")
    per_loan = tw.binary_cost(pred, F.col("y"), F.col("lam_pn"), F.col("lam_np"))
    fixed = tw.binary_cost(pred, F.col("y"), F.lit(1.0), F.lit(5.0))
    return priced(spark, folder).groupBy("loan_purpose").agg(
        F.round(F.sum(per_loan), 2).alias("cost_loan"), F.round(F.sum(fixed), 2).alias("cost_fixed")
    )


def grid_sql(steps: int, cost: str = "realised", width: str = "all") -> str:
    """Brute-force check of a grid pass: every candidate against every loan."""
    price = {
        "realised": """case when p_default >= alpha then case when y = 0 then lam_pn else 0 end
            when p_default <= beta then case when y = 1 then lam_np else 0 end
            else case when y = 1 then u * lam_np else v * lam_pn end end""",
        "expected": """case when p_default >= alpha then lam_pn * (1 - p_default) when p_default <= beta then lam_np * p_default
            else u * lam_np * p_default + v * lam_pn * (1 - p_default) end""",
    }[cost]
    gap = "alpha - beta" if width == "all" else "case when p_default < alpha and p_default > beta then alpha - beta else 0 end"
    return f""", cand as (select i / {steps}::double as u, j / {steps}::double as v from range({steps + 1}) a(i), range({steps + 1}) b(j)
        where i + j <= {steps}),
    each as (select u, v, y, p_default, lam_pn, lam_np,
       coalesce((lam_pn - v * lam_pn) / nullif((lam_pn - v * lam_pn) + u * lam_np, 0), 1.0) as alpha,
       coalesce(v * lam_pn / nullif(v * lam_pn + (lam_np - u * lam_np), 0), 0.0) as beta from scored, cand),
    scores as (select u, v, round(sum({price}), 2) as f1, round(sum({gap}), 4) as f2,
       count(*) filter (where p_default < alpha and p_default > beta) as bnd,
       count(*) filter (where p_default >= alpha and y = 1) as tp, count(*) filter (where p_default < alpha and y = 0) as tn,
       count(*) filter (where p_default >= alpha and y = 0) as fp, count(*) filter (where p_default < alpha and y = 1) as fn,
       count(*) as n from each group by u, v)
    """


def grid_scores(spark, folder, steps: int, **options) -> DataFrame:
    scores = sr.objectives(priced(spark, folder), sr.grid(steps, 0.0), **options)
    return scores.withColumns({"f1": F.round("f1", 2), "f2": F.round("f2", 4)})


@query("twd7_objectives", grid_sql(20) + "select u, v, f1, f2 from scores", loans=True)
def twd7(spark, folder):
    return grid_scores(spark, folder, 20).select("u", "v", "f1", "f2")


@query("twd7_objectives_expected", grid_sql(10, "expected", "bnd") + "select u, v, f1, f2 from scores", loans=True)
def twd7_expected(spark, folder):
    return grid_scores(spark, folder, 10, cost="expected", width="bnd").select("u", "v", "f1", "f2")


@query(
    "twd8_boundary_share",
    grid_sql(10) + "select u, v, bnd, round(bnd / n::double, 6) as bnd_share from scores",
    loans=True,
)
def twd8(spark, folder):
    return grid_scores(spark, folder, 10).select("u", "v", "bnd", F.round(F.col("bnd") / F.col("n"), 6).alias("bnd_share"))


FRONT = """, edge as (select * from scores s where not exists (select 1 from scores t
    where t.f1 <= s.f1 and t.f2 <= s.f2 and (t.f1 < s.f1 or t.f2 < s.f2)))
"""


@query("twd9_front", grid_sql(20) + FRONT + "select u, v, f1, f2 from edge", loans=True)
def twd9(spark, folder):
    return sr.front(grid_scores(spark, folder, 20)).select("u", "v", "f1", "f2")


def rule_sql(order: str) -> str:
    return grid_sql(20) + FRONT + f"select u, v, f1, f2, bnd from edge order by {order}, u, v limit 1"


def by_rule(rule: str):
    def run(spark, folder):
        return sr.choose(sr.front(grid_scores(spark, folder, 20)), rule).select("u", "v", "f1", "f2", "bnd")

    return run


query("twd10_rule_cost", rule_sql("f1, f2"), loans=True)(by_rule("cost"))
query("twd10_rule_boundary", rule_sql("bnd, f1"), loans=True)(by_rule("boundary"))
query("twd10_rule_width", rule_sql("f2, f1"), loans=True)(by_rule("width"))
query(
    "twd10_rule_accuracy",
    grid_sql(20)
    + FRONT
    + """, rated as (select *, 0.5::double * (tp / (tp + fn + 1e-9::double) + tn / (tn + fp + 1e-9::double)) as bacc, bnd / n::double <= 0.05::double as ok from edge),
    best as (select *, coalesce(ok and abs(bacc - top) <= 1e-8::double + 1e-5::double * top, false) as near
        from rated, (select max(bacc) filter (where ok) as top from rated) m)
    select u, v, f1, f2, bnd from best order by near desc, case when not near then bnd end nulls first, f1, u, v limit 1""",
    loans=True,
)(by_rule("accuracy"))


@query(
    "twd10_rule_boundary_strict",
    grid_sql(20).replace("where i + j <= 20", "where i + j < 20") + FRONT
    + "select u, v, f1, f2, bnd from edge order by bnd, f1, u, v limit 1",
    loans=True,
)
def twd10_strict(spark, folder):
    """The fewest boundary loans short of u + v = 1, where there would be none by construction."""
    scores = sr.objectives(priced(spark, folder), sr.grid(20)).withColumns({"f1": F.round("f1", 2), "f2": F.round("f2", 4)})
    return sr.choose(sr.front(scores), "boundary").select("u", "v", "f1", "f2", "bnd")


def zoom_sql(steps: int) -> str:
    """Grid of ``steps``, then the half steps around its front: brute force over the finer grid, marked by place."""
    fine = 2 * steps
    return grid_sql(fine).replace(f"where i + j <= {fine}", f"where i + j < {fine}") + f""", placed as (
      select *, cast(round(u * {fine}) as int) as i, cast(round(v * {fine}) as int) as j from scores),
    coarse as (select * from placed where i % 2 = 0 and j % 2 = 0),
    first as (select * from coarse s where not exists (select 1 from coarse t
      where t.f1 <= s.f1 and t.f2 <= s.f2 and (t.f1 < s.f1 or t.f2 < s.f2))),
    tried as (select * from placed p where (i % 2 = 0 and j % 2 = 0)
      or exists (select 1 from first f where abs(f.i - p.i) <= 1 and abs(f.j - p.j) <= 1))
    select u, v, f1, f2 from tried s where not exists (select 1 from tried t
      where t.f1 <= s.f1 and t.f2 <= s.f2 and (t.f1 < s.f1 or t.f2 < s.f2))"""


@query("twd9_zoom", zoom_sql(10), loans=True)
def twd9_zoom(spark, folder):
    """Front after one zoom round around the front of a coarse grid."""
    loans = settle(priced(spark, folder))
    rounded = lambda c: sr.objectives(loans, c).withColumns({"f1": F.round("f1", 2), "f2": F.round("f2", 4)})
    coarse = rounded(sr.grid(10))
    rows = coarse.collect()  # one row a candidate
    edge = sr.front(spark.createDataFrame(rows, coarse.schema)).select("u", "v").collect()
    known = {(r.u, r.v) for r in rows}
    finer = rounded([c for c in sr.zoom([(r.u, r.v) for r in edge], 0.1) if c not in known])
    return sr.front(spark.createDataFrame(rows, coarse.schema).unionByName(finer)).select("u", "v", "f1", "f2")


@query("twd9_certified_search")
def twd9_certified(spark, folder):
    """Least cost with at most a tenth of the loans in the boundary, and the bound that no choice can beat."""
    found = ce.certified_search(priced(spark, folder), 0.1, 0.01)
    row = (found.u, found.v, found.cost, found.boundary, found.lower, found.passes, found.open_boxes)
    return spark.createDataFrame([row], "u double, v double, cost double, boundary bigint, lower double, passes int, open_boxes int")


HOLES = {"p_default": "loan_id % 7 = 0", "lam_pn": "loan_id % 11 = 0", "lam_np": "loan_id % 13 = 0", "y": "loan_id % 5 = 0"}


@query(
    "twd7_objectives_nulls",
    ", holes as (select loan_id, " + ", ".join(f"case when {w} then null else {c} end as {c}" for c, w in HOLES.items()) + """ from scored),
    cand as (select i / 4::double as u, j / 4::double as v from range(5) a(i), range(5) b(j) where i + j < 4),
    each as (select u, v, y, p_default as p, lam_pn, lam_np,
       case when (lam_pn - v * lam_pn) + u * lam_np = 0 then 1.0 else (lam_pn - v * lam_pn) / ((lam_pn - v * lam_pn) + u * lam_np) end as alpha,
       case when v * lam_pn + (lam_np - u * lam_np) = 0 then 0.0 else v * lam_pn / (v * lam_pn + (lam_np - u * lam_np)) end as beta from holes, cand),
    placed as (select *, case when p >= alpha then 'POS' when p <= beta then 'NEG' else 'BND' end as region from each)
    select u, v, count(*) as n, count(*) filter (where region = 'BND') as bnd, round(sum(alpha - beta), 4) as f2,
      round(sum(case region when 'POS' then case when y = 0 then lam_pn end when 'NEG' then case when y = 1 then lam_np end
        else case when y = 1 then u * lam_np else v * lam_pn end end), 2) as f1,
      count(*) filter (where region = 'POS' and y = 1) as tp, count(*) filter (where region <> 'POS' and y = 0) as tn
    from placed group by u, v""",
    loans=True,
)
def twd7_nulls(spark, folder):
    """Loans with a missing score, loss or label stay in every count, as in the decision."""
    loans = priced(spark, folder)
    loans = loans.withColumns({c: F.when(~F.expr(w), F.col(c)) for c, w in HOLES.items()})
    return sr.objectives(loans, sr.grid(4)).select(
        "u", "v", "n", "bnd", F.round("f2", 4).alias("f2"), F.round("f1", 2).alias("f1"), "tp", "tn")


@query(
    "twd11_decision_counts",
    DECIDED
    + """select region, count(*) as n, round(sum(case region when 'POS' then lam_pn * (1 - p_default) when 'NEG' then lam_np * p_default
        else u * lam_np * p_default + v * lam_pn * (1 - p_default) end), 2) as cost from decided group by region""",
    loans=True,
)
def twd11(spark, folder):
    cost = tw.expected_cost(F.col("region"), F.col("p_default"), F.col("lam_pn"), F.col("lam_np"), F.lit(U), F.lit(V))
    return decided(spark, folder).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(cost), 2).alias("cost"))


SECOND_SQL = "cast(installment_number % 2 = 0 as int)"


@query(
    "twd12_resolved",
    DECIDED
    + f"""select loan_id, region, case region when 'POS' then 1 when 'NEG' then 0 else {SECOND_SQL} end as final_pred from decided""",
    loans=True,
)
def twd12(spark, folder):
    """The second opinion is a given prediction column; see ``flow_cross_validated`` for a trained one."""
    out = decided(spark, folder)
    second = out.where(F.col("region") == "BND").select("loan_id", (F.col("installment_number") % 2 == 0).cast("int").alias("pred"))
    return tw.resolve_boundary(out, second).select("loan_id", "region", "final_pred")


@query(
    "twd13_loss_matrix",
    """select loan_id, action, round(d, 7) as loss_default, round(g, 7) as loss_good from (
      select loan_id, 'accept' as action, 0.0::double as d, lam_pn as g from scored
      union all select loan_id, 'defer', 0.3::double * lam_np, 0.4::double * lam_pn from scored
      union all select loan_id, 'reject', lam_np, 0.0::double from scored)""",
    loans=True,
)
def twd13(spark, folder):
    return tw.loss_matrix(priced(spark, folder), U, V).select(
        "loan_id", "action", F.round("loss_default", 7).alias("loss_default"), F.round("loss_good", 7).alias("loss_good")
    )


@query(
    "twd13_loss_matrix_first3",
    """, f as (select *, row_number() over (partition by loan_purpose order by loan_id) as rn from scored)
    select loan_purpose, loan_id, action, round(d, 7) as loss_default, round(g, 7) as loss_good from (
      select loan_purpose, loan_id, rn, 'accept' as action, 0.0::double as d, lam_pn as g from f
      union all select loan_purpose, loan_id, rn, 'defer', 0.3::double * lam_np, 0.4::double * lam_pn from f
      union all select loan_purpose, loan_id, rn, 'reject', lam_np, 0.0::double from f) where rn <= 3""",
    loans=True,
)
def twd13_first3(spark, folder):
    """The first three samples of every group: a group limit that is pushed before the shuffle."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("loan_purpose").orderBy("loan_id"))
    first = priced(spark, folder).withColumn("rn", rn).where("rn <= 3")
    purposes = first.select("loan_id", "loan_purpose")
    return tw.loss_matrix(first, U, V).join(purposes, "loan_id").select(
        "loan_purpose", "loan_id", "action", F.round("loss_default", 7).alias("loss_default"), F.round("loss_good", 7).alias("loss_good")
    )


def sensitivity(df: DataFrame, settings: list[int]) -> DataFrame:
    """Cost and boundary size for coarser and finer grids; cost by the width rule, size by the boundary rule."""
    out = None
    for steps in settings:
        scores = sr.objectives(df, sr.grid(steps, 0.0)).withColumns({"f1": F.round("f1", 2), "f2": F.round("f2", 4)})
        edge = sr.front(scores)
        cost = sr.choose(edge, "width").select(F.lit(steps).alias("steps"), F.col("f1").alias("cost"))
        size = sr.choose(edge, "boundary").select(F.lit(steps).alias("steps"), "bnd")
        row = cost.join(size, "steps")
        out = row if out is None else out.unionByName(row)
    return out


SENSITIVITY = (5, 10, 20)


def sensitivity_sql(settings) -> str:
    parts = []
    for i, s in enumerate(settings):
        body = (grid_sql(s) + FRONT).lstrip(", \n")
        for name in ("cand", "each", "scores", "edge"):
            body = body.replace(f"{name} as (", f"{name}{i} as (").replace(f"from {name} ", f"from {name}{i} ")
            body = body.replace(f"scored, {name})", f"scored, {name}{i})").replace(f"from {name} group", f"from {name}{i} group")
        parts.append(body)
    rows = [
        f"""select {s} as steps, (select f1 from edge{i} order by f2, f1, u, v limit 1) as cost,
        (select bnd from edge{i} order by bnd, f1, u, v limit 1) as bnd"""
        for i, s in enumerate(settings)
    ]
    return ", " + ", ".join(parts) + " union all ".join(rows)


@query("twd14_sensitivity", sensitivity_sql(SENSITIVITY), loans=True)
def twd14(spark, folder):
    return sensitivity(priced(spark, folder), list(SENSITIVITY))
