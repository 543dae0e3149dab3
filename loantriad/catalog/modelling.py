"""Queries for the learners, the ensembles and the composed flow.

Fitted models have no SQL equivalent, so most are checked for rows only here and for quality in the
tests. Votes, cost-sensitive decisions and neighbour classes are checked with SQL on given inputs.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from loantriad.catalog.registry import query
from loantriad.models import ensembles as es
from loantriad.models import histograms as hi
from loantriad.models import learners as le
from loantriad.models import machines as ma
from loantriad.models import selection as se
from loantriad.operators import threeway as tw
from loantriad.operators.evaluate import class_counts, fold_summary, importance_summary
from loantriad.operators.sampling import train_test_split
from loantriad.plans import credit_flow as cf
from loantriad.plans.loans import GOOD_STATUS, loans, table
from loantriad.plans.prepare import Roles, prepare
from loantriad.session import is_stored, materialise

NAMES = cf.FEATURES


def report(spark, folder, model: Estimator, prepare=None) -> DataFrame:
    """Fit on four folds, evaluate on the fifth."""
    train, test = cf.fold_rows(cf.model_table(spark, folder), 0)
    if prepare:
        train = prepare(train)
    cost = tw.binary_cost(F.col("pred"), F.col("y"), F.col("lam_pn"), F.col("lam_np"))
    return se.train_and_evaluate({"model": model}, le.assemble(train, NAMES), le.assemble(test, NAMES), cost)


@query("ml1_gradient_boosting")
def ml1(spark, folder):
    return report(spark, folder, le.gradient_boosting(300, 0.05))


@query("ml1_leafwise_boosting")
def ml1_leafwise(spark, folder):
    """Leaf-wise trees of 31 leaves from histograms; 20 rounds at a rate of 0.3."""
    return report(spark, folder, hi.HistogramBoosting(20, 0.3))


@query("ml2_extra_trees")
def ml2_extra(spark, folder):
    """200 extremely randomised trees, grown together."""
    return report(spark, folder, hi.HistogramForest(200, 0.0, random_cuts=True))


@query("ml2_random_forest")
def ml2(spark, folder):
    """200 trees, grown together."""
    return report(spark, folder, hi.random_forest(200))


@query("ml3_decision_tree")
def ml3(spark, folder):
    """Balanced class weights, at least two rows per leaf."""
    return report(spark, folder, le.decision_tree(2, weight="weight"), le.balanced_weights)


@query("ml4_logistic")
def ml4(spark, folder):
    return report(spark, folder, le.logistic(100))


@query("ml5_linear_svm")
def ml5(spark, folder):
    return report(spark, folder, le.linear_svm())


def vector_classes(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Vectors of ten classes, four fifths to learn from."""
    data = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("y"), "embedding")
    data = data.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).drop("embedding")
    return train_test_split(data, "vec_id", 0.2)


def class_report(model: Estimator, parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    scored = model.fit(parts[0]).transform(parts[1])
    return class_counts(scored.withColumn("pred", F.col("prediction").cast("int")), "y", "pred")


@query("ml5_linear_svm_classes")
def ml5_classes(spark, folder):
    """Ten classes of vectors, one machine per class."""
    return class_report(le.linear_svm(many_classes=True), vector_classes(spark, folder))


@query("ml5_pairwise_machines")
def ml5_pairwise(spark, folder):
    """Ten classes of vectors, one machine per pair of classes."""
    return class_report(ma.PairwiseMachines(), vector_classes(spark, folder))


@query("ml5_radial_machine")
def ml5_radial(spark, folder):
    """A radial kernel by 200 random Fourier features."""
    return report(spark, folder, ma.RadialMachine())


@query("ml6_gaussian_bayes")
def ml6(spark, folder):
    return report(spark, folder, le.gaussian_bayes())


# what the model table holds, one row per loan and feature
TRAINING_SQL = ", t as (unpivot (select loan_id, y, " + ", ".join(
    {"monthly_income": "coalesce(monthly_income, avg(monthly_income) over ())", "loan_days": "date_diff('day', date '2000-01-01', loan_date::date)"}.get(c, c)
    + f"::double as {c}" for c in NAMES
) + f" from scored) on {', '.join(NAMES)} into name feature value x)\n"


@query(
    "ml6_class_moments",
    TRAINING_SQL + """, w as (select max(v) as widest from (select var_pop(x) as v from t group by feature))
select y::int as y, feature, round(count(*) / (select count(*) from scored)::double, 9) as prior, round(avg(x), 5) as mean,
       round(sqrt(var_pop(x) + 1e-9 * any_value(widest)), 3) as sd from t, w group by y, feature""",
    loans=True,
)
def ml6_moments(spark, folder):
    """The fitted normal distributions of the Bayes learner: class moments, widened by 1e-9 of the widest feature's variance."""
    model = le.gaussian_bayes().fit(le.assemble(cf.model_table(spark, folder), NAMES))
    rows = [
        (y, f, float(math.exp(model.pi[y])), float(model.theta[y, i]), float(math.sqrt(model.sigma[y, i])))
        for y in range(model.numClasses) for i, f in enumerate(NAMES)
    ]
    out = spark.createDataFrame(rows, "y int, feature string, prior double, mean double, sd double")
    return out.withColumns({"prior": F.round("prior", 9), "mean": F.round("mean", 5), "sd": F.round("sd", 3)})


@query(
    "ml10_discriminant_equations",
    TRAINING_SQL + """select y::int as y, feature, round(avg(x), 2) as mean,
                             round(count(*) / (select count(*) from scored)::double, 6) as prior from t group by y, feature""",
    loans=True,
)
def ml10_equations(spark, folder):
    """The fitted weights put back: pooled covariance x weights is the class mean, and the offset gives the prior."""
    data = cf.model_table(spark, folder)
    model = es.LinearDiscriminant(NAMES).fit(data)
    centre = data.groupBy("y").agg(*[F.avg(c).alias(f"_m_{c}") for c in NAMES])
    gaps = {c: F.col(c) - F.col(f"_m_{c}") for c in NAMES}
    apart = data.join(F.broadcast(centre), "y")  # one row per class
    row = apart.agg(F.count(F.lit(1)).alias("n"), *[F.sum(gaps[a] * gaps[b]).alias(f"{a}|{b}") for a in NAMES for b in NAMES]).first()
    rows = []
    for y, weights, offset in model.classes:
        mean = [sum(row[f"{a}|{b}"] * w for b, w in zip(NAMES, weights)) / (row.n - len(model.classes)) for a in NAMES]
        prior = math.exp(offset + 0.5 * sum(m * w for m, w in zip(mean, weights)))
        rows += [(y, f, m, prior) for f, m in zip(NAMES, mean)]
    out = spark.createDataFrame(rows, "y int, feature string, mean double, prior double")
    return out.withColumns({"mean": F.round("mean", 2), "prior": F.round("prior", 6)})


@query("ml7_perceptron")
def ml7(spark, folder):
    return report(spark, folder, le.perceptron(len(NAMES)))


@query("ml9_adaboost")
def ml9(spark, folder):
    return report(spark, folder, es.AdaBoostClassifier(NAMES))


@query("ml10_linear_discriminant")
def ml10(spark, folder):
    return report(spark, folder, es.LinearDiscriminant(NAMES))


@query("ml11_bagging")
def ml11(spark, folder):
    return report(spark, folder, es.BaggingClassifier(lambda: le.decision_tree(weight="copies"), NAMES, "loan_id", 10))


@query("ml11_bagging_out_of_bag")
def ml11_oob(spark, folder):
    """200 bags of 80 % of rows and of features, grown together; accuracy of the rows that bags have not seen."""
    data = le.assemble(cf.model_table(spark, folder), NAMES)
    out = hi.HistogramForest(200, 0.8, 0.8, "loan_id").fit(data).out_of_bag().where("prob is not null")
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("prob") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"))


@query("ml11_bagged_forests")
def ml11_forests(spark, folder):
    forest = lambda: le.random_forest(5, 5, weight="copies")
    return report(spark, folder, es.BaggingClassifier(forest, NAMES, "loan_id", 4))


@query("ml12_stacking")
def ml12(spark, folder):
    bases = {
        "rf": lambda: le.random_forest(5, 5), "gbt": lambda: le.gradient_boosting(3, 0.1, 4), "ada": lambda: es.AdaBoostClassifier(NAMES, 3),
    }
    return report(spark, folder, es.StackingClassifier(bases, NAMES, "loan_id", folds=3))


VOTES = {"a": "p_default", "b": "installment_number / 14.0", "c": "loan_rate / 10.0"}


@query(
    "ml13_vote",
    """, v as (select loan_id, p_default as a, installment_number / 14.0::double as b, loan_rate::double / 10.0::double as c from loans)
    select loan_id, round((a + b + c) / 3, 8) as average,
      (2 * ((a >= 0.5::double)::int + (b >= 0.5::double)::int + (c >= 0.5::double)::int) > 3)::int as majority from v""",
    loans=True,
)
def ml13(spark, folder):
    df = loans(spark, folder).select(
        "loan_id", F.col("p_default").alias("a"), (F.col("installment_number") / F.lit(14.0)).alias("b"), (F.col("loan_rate") / F.lit(10.0)).alias("c")
    )
    df = df.withColumns({f"d{n}": (F.col(n) >= 0.5).cast("int") for n in "abc"})
    return df.select("loan_id", F.round(es.vote_average(["a", "b", "c"]), 8).alias("average"), es.vote_majority(["da", "db", "dc"]).alias("majority"))


@query("ml13_vote_fitted")
def ml13_fitted(spark, folder):
    """Tree, margin and logistic learners, averaged."""
    learners = {"tree": lambda: le.decision_tree(3), "svm": lambda: le.linear_svm(10), "logistic": lambda: le.logistic(20)}
    return report(spark, folder, es.VoteClassifier(learners))


COSTS = [[0.0, 10.0, 10.0, 10.0], [10.0, 0.0, 10.0, 5.0], [10.0, 10.0, 0.0, 10.0], [30.0, 10.0, 10.0, 0.0]]
STATES = ["active", "doubtful", "overdue", " settled "]


def least_cost_sql(costs) -> str:
    terms = [" + ".join(f"p{j} * {costs[j][k]}::double" for j in range(4)) for k in range(4)]
    each = ", ".join(f"({t})" for t in terms)
    return f"(list_position([{each}], list_min([{each}])) - 1)::int"


SHARES = ", s as (select customer_id, " + ", ".join(
    f"count(*) filter (where status = '{s}') / count(*)::double as p{i}" for i, s in enumerate(STATES)
) + " from loans where status is not null group by customer_id)\n"


@query(
    "ml14_least_cost",
    SHARES + f"select customer_id, {least_cost_sql(COSTS)} as called, {least_cost_sql(es.uniform_costs(4))} as plain from s",
    loans=True,
)
def ml14(spark, folder):
    """Status shares of a customer as probabilities; uneven costs against uniform ones."""
    n = F.count(F.lit(1)).cast("double")
    shares = [(F.count_if(F.col("status") == s) / n).alias(f"p{i}") for i, s in enumerate(STATES)]
    df = loans(spark, folder).where("status is not null").groupBy("customer_id").agg(*shares)
    p = F.array("p0", "p1", "p2", "p3")
    return df.select("customer_id", es.least_cost_class(p, COSTS).alias("called"), es.least_cost_class(p, es.uniform_costs(4)).alias("plain"))


@query("ml14_cost_sensitive")
def ml14_fitted(spark, folder):
    return report(spark, folder, es.CostSensitiveClassifier(lambda: le.logistic(20), [[0.0, 1.0], [4.0, 0.0]]))


@query("ml15_feature_elimination")
def ml15(spark, folder):
    """Cross-validated ROC area by number of features, and which are kept: five folds, one feature a step, all features."""
    chosen, areas = hi.eliminate_together(cf.model_table(spark, folder), "loan_id", NAMES, folds=5, protected=("loan_amount",))
    return spark.createDataFrame([(n, v, ",".join(chosen)) for n, v in sorted(areas.items())], "features int, score double, chosen string")


@query("ml16_importance")
def ml16(spark, folder):
    data = cf.model_table(spark, folder)
    model = hi.random_forest(200).fit(le.assemble(data, NAMES))
    rows = [(f, w, 0) for f, w in le.importances(model, NAMES)]
    return importance_summary(spark.createDataFrame(rows, "feature string, importance double, fold int"))


@query("evl9_train_and_evaluate")
def evl9(spark, folder):
    train, test = (le.assemble(p, NAMES) for p in cf.fold_rows(cf.model_table(spark, folder), 0))
    models = {"logistic": le.logistic(20), "tree": le.decision_tree(depth=4), "bayes": le.gaussian_bayes(), "lda": es.LinearDiscriminant(NAMES)}
    cost = tw.binary_cost(F.col("pred"), F.col("y"), F.col("lam_pn"), F.col("lam_np"))
    return se.train_and_evaluate(models, train, test, cost)


def raw_loans(spark, folder) -> DataFrame:
    """The loans as a raw table has them: numbers as text with words between, gaps, an empty, a rare and a doubled column."""
    key = F.col("loan_id")
    text = lambda c, step, word: F.when(key % step == 0, word).otherwise(F.col(c).cast("string")).alias(c)
    gap = lambda c, step: F.when(key % step != 0, F.col(c)).alias(c)
    return loans(spark, folder).select(
        "loan_id", "status", "branch_code", gap("contract_type", 71), "loan_purpose", text("loan_amount", 89, "n/a"), text("loan_rate", 83, "?"),
        gap("duration_years", 79), text("installment_number", 67, "-1"), "monthly_income", gap("loan_date", 73),
        F.lit(None).cast("double").alias("nothing"), F.when(key % 10 == 0, F.col("p_default")).alias("rare"), (F.col("monthly_income") * 2 + 1).alias("doubled"),
    )


PREPARED_SQL = """, raw as (
select loan_id, case when status is null then 1 when trim(status) in ('settled', 'active') then 0 else 1 end as y, loan_purpose,
       case when loan_id % 71 <> 0 then contract_type end as contract_type, loan_amount,
       case when loan_id % 83 <> 0 then loan_rate end as rate, case when loan_id % 79 <> 0 then duration_years end as duration_years,
       installment_number::double as installment_number, monthly_income, case when loan_id % 73 <> 0 then loan_date end as loan_date,
       branch_code, case when loan_id % 10 = 0 then p_default end as rare, monthly_income * 2 + 1 as doubled
from loans where loan_id % 89 <> 0 and loan_id % 67 <> 0 and loan_amount >= 0),
priced as (
select * exclude (rate), coalesce(rate, avg(rate) over ()) as loan_rate,
       loan_amount * (coalesce(rate, avg(rate) over ()) / 100.0) * coalesce(duration_years, 1) as interest_cash,
       epoch(loan_date::timestamp)::double as loan_date_seconds
from raw),
cells as (
unpivot (select loan_id, branch_code::double as branch_code, loan_amount, loan_rate, duration_years::double as duration_years,
                installment_number, monthly_income, rare, doubled from priced)
on branch_code, loan_amount, loan_rate, duration_years, installment_number, monthly_income, rare, doubled into name col value x),
-- columns stand in the raw order of the table
places as (select distinct col, case col when 'branch_code' then 1 when 'loan_amount' then 2 when 'loan_rate' then 3 when 'duration_years' then 4
                                   when 'installment_number' then 5 when 'monthly_income' then 6 when 'rare' then 7 else 8 end as place from cells),
dropped as (
select distinct b.col from cells a join cells b using (loan_id) join places pa on pa.col = a.col join places pb on pb.col = b.col
where pa.place < pb.place and b.col not in ('loan_amount', 'loan_rate') group by a.col, b.col having abs(corr(a.x, b.x)) > 0.7),
sparse as (select col from cells group by col having count(*) < floor(0.2 * (select count(*) from priced))),
wide as (
select loan_id, y, coalesce(contract_type, (select contract_type from priced where contract_type is not null group by 1 order by count(*) desc, 1 limit 1)) as contract_type,
       loan_purpose, interest_cash, coalesce(loan_date_seconds, median(loan_date_seconds) over ()) as loan_date_seconds,
       coalesce(branch_code, avg(branch_code) over ())::double as branch_code, loan_amount, loan_rate,
       coalesce(duration_years, avg(duration_years) over ())::double as duration_years, installment_number,
       coalesce(monthly_income, avg(monthly_income) over ()) as monthly_income, coalesce(rare, avg(rare) over ()) as rare,
       coalesce(doubled, avg(doubled) over ()) as doubled
from priced),
long as (
unpivot (select * exclude (contract_type, loan_purpose) from wide)
on interest_cash, loan_date_seconds, branch_code, loan_amount, loan_rate, duration_years, installment_number, monthly_income, rare, doubled
into name feature value x),
hot as (
select loan_id, y, 'contract_type_' || v as feature, (contract_type = v)::int::double as x
from wide cross join (select distinct contract_type as v from wide where contract_type > (select min(contract_type) from wide))
union all
select loan_id, y, 'loan_purpose_' || v, (loan_purpose = v)::int::double
from wide cross join (select distinct loan_purpose as v from wide where loan_purpose > (select min(loan_purpose) from wide)))
select loan_id, y, feature, round(x + 0.0000123, 3) as x from long
where feature not in (select col from dropped) and feature not in (select col from sparse)
union all select loan_id, y, feature, round(x + 0.0000123, 3) from hot
"""


@query("flow_preprocessing", PREPARED_SQL, loans=True)
def flow_preprocessing(spark, folder):
    """Every cell of the prepared loan table: which columns are left and what is in them."""
    out = prepare(raw_loans(spark, folder), Roles(good=GOOD_STATUS))
    # exact interests have six decimals at most: the shift keeps them off the middle between two roundings
    cells = [F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double") + 0.0000123, 3).alias("x")) for c in out.columns if c not in ("loan_id", "y")]
    return out.select("loan_id", "y", F.inline(F.array(*cells)))


def flow_settings() -> cf.Settings:
    """5 folds, 10 bags, SMOTE, recursive elimination of all features on 5 inner folds; 20 boosting rounds (README)."""
    return cf.Settings(risk=lambda: le.gradient_boosting(20, 0.3), together=True, resolver="forest")


def flow_rows(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Data and fold rows of the flow, made once a session for the queries that show them."""
    kept = spark.sparkContext.__dict__.setdefault("_loantriad_flows", {})
    if folder not in kept or not all(is_stored(t) for t in kept[folder]):
        cfg = flow_settings()
        data = materialise(cf.model_table(spark, folder, cfg.folds), "flow-table")
        kept[folder] = data, cf.cross_validated(data, cfg)[0]
    return kept[folder]


@query("flow_cross_validated")
def flow(spark, folder):
    """Every step of the composed flow on five folds: eliminate, balance, score, search, decide, resolve, evaluate."""
    return flow_rows(spark, folder)[1]


@query("flow_fold_summary")
def flow_summary(spark, folder):
    return fold_summary(flow_rows(spark, folder)[1], ["bacc", "gm", "fm", "auc", "precision", "recall", "cost", "tp", "tn", "fp", "fn"])


@query("flow_comparison")
def flow_comparison(spark, folder):
    data, rows = flow_rows(spark, folder)
    models = {"RandomForest": lambda: le.random_forest(50), "ExtraTrees": lambda: hi.HistogramForest(50, 0.0, random_cuts=True),
              "Bagging": lambda: hi.HistogramForest(10), "Logistic": lambda: le.logistic(100)}
    return cf.compare(cf.baselines(data, models, flow_settings()), rows)
