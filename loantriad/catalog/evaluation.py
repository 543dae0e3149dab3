"""Queries for confusion counts, scores, AUC and the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.catalog.registry import query
from loantriad.operators import evaluate as ev
from loantriad.operators import threeway as tw
from loantriad.plans.loans import labelled_loans, table

METRICS = ["bacc", "gm", "fm", "precision", "recall", "cost", "tp", "tn", "fp", "fn"]


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    df = tw.loss_columns(labelled_loans(spark, folder))
    return df.withColumn("pred", (F.col("p_default") >= 0.5).cast("int"))



def loan_cost():
    return tw.binary_cost(F.col("pred"), F.col("y"), F.col("lam_pn"), F.col("lam_np"))


PRED = ", d as (select *, cast(p_default >= cast(0.5 as double) as int) as pred from scored)\n"
COUNTS_SQL = """count(*) filter (where y = 1 and pred = 1) as tp, count(*) filter (where y = 0 and pred = 0) as tn,
    count(*) filter (where y = 0 and pred = 1) as fp, count(*) filter (where y = 1 and pred = 0) as fn"""
COST_SQL = "sum(case when pred = 1 and y = 0 then lam_pn when pred = 0 and y = 1 then lam_np else 0.0 end) as cost"


def metric_sql(source: str) -> str:
    """Scores from a relation with tp, tn, fp, fn."""
    return f"""(select *, (recall + specificity) / 2 as bacc,
        case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as fm,
        sqrt(recall * specificity) as gm, (tp + tn) / (tp + tn + fp + fn)::double as accuracy from
      (select *, case when tp + fp = 0 then 0 else tp / (tp + fp)::double end as precision,
        case when tp + fn = 0 then 0 else tp / (tp + fn)::double end as recall,
        case when tn + fp = 0 then 0 else tn / (tn + fp)::double end as specificity from {source}))"""


@query("evl1_confusion", PRED + f"select loan_purpose, {COUNTS_SQL} from d group by loan_purpose", loans=True)
def evl1(spark, folder):
    return predicted(spark, folder).groupBy("loan_purpose").agg(*ev.confusion_aggs())


SHOWN = ["precision", "recall", "specificity", "bacc", "fm", "gm", "accuracy"]


@query(
    "evl2_metrics",
    PRED
    + f"select tp, tn, fp, fn, round(cost, 2) as cost, {', '.join(f'round({m}, 6) as {m}' for m in SHOWN)} from "
    + metric_sql(f"(select {COUNTS_SQL}, {COST_SQL} from d)"),
    loans=True,
)
def evl2(spark, folder):
    out = ev.evaluate(predicted(spark, folder), cost=loan_cost())
    return out.select("tp", "tn", "fp", "fn", F.round("cost", 2).alias("cost"), *[F.round(m, 6).alias(m) for m in SHOWN])


@query(
    "evl3_auc",
    """, c as (select p_default as s, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from scored group by 1),
    w as (select *, sum(neg) over (order by s) - neg as below from c)
    select round(cast(sum(pos * (below + neg / 2.0::double)) as double) / (cast(sum(pos) as double) * cast(sum(neg) as double)), 6) as auc from w""",
    loans=True,
)
def evl3(spark, folder):
    return ev.auc(labelled_loans(spark, folder)).select(F.round("auc", 6).alias("auc"))


@query(
    "evl3_auc_labels",
    """, c as (select d.n_chars as s, count(*) filter (where l.quality = 1) as pos, count(*) filter (where l.quality = 0) as neg
      from labels l join documents d using (doc_id) group by 1),
    w as (select *, sum(neg) over (order by s) - neg as below from c)
    select round(cast(sum(pos * (below + neg / 2.0::double)) as double) / (cast(sum(pos) as double) * cast(sum(neg) as double)), 6) as auc from w""",
    loans=True,
)
def evl3_labels(spark, folder):
    d = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return ev.auc(d, "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


MULTI = ", m as (select branch_code % 5 as actual, (branch_code + loan_id % 2) % 5 as predicted from loans)\n"


def multi(spark, folder):
    from loantriad.plans.loans import loans

    return loans(spark, folder).select(
        (F.col("branch_code") % 5).alias("actual"),
        ((F.col("branch_code") + F.col("loan_id") % 2) % 5).cast("int").alias("predicted"),
    )


@query("evl4_class_matrix", MULTI + "select actual, predicted::int as predicted, count(*) as n from m group by 1, 2", loans=True)
def evl4_matrix(spark, folder):
    return ev.class_counts(multi(spark, folder), "actual", "predicted")


@query(
    "evl4_class_report",
    MULTI
    + """, k as (select distinct actual as class from m),
    r as (select class, (select count(*) from m where actual = class) as support, (select count(*) from m where predicted = class) as called,
      (select count(*) from m where actual = class and predicted = class) as hit from k)
    select class, support, round(hit / called::double, 6) as precision, round(hit / support::double, 6) as recall,
      round(2 * (hit / called::double) * (hit / support::double) / ((hit / called::double) + (hit / support::double)), 6) as f1 from r""",
    loans=True,
)
def evl4(spark, folder):
    out = ev.class_report(multi(spark, folder), "actual", "predicted")
    return out.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "evl4_accuracy",
    MULTI + "select round(avg(case when actual = predicted then 1.0::double else 0.0::double end), 6) as accuracy from m",
    loans=True,
)
def evl4_accuracy(spark, folder):
    return ev.accuracy(multi(spark, folder), "actual", "predicted").select(F.round("accuracy", 6).alias("accuracy"))


FOLDS = PRED + f", folds as (select * from {metric_sql(f'(select loan_id % 5 as fold, {COUNTS_SQL}, {COST_SQL} from d group by 1)')})\n"


def folds(spark, folder) -> DataFrame:
    df = predicted(spark, folder).withColumn("fold", F.col("loan_id") % 5)
    return ev.evaluate(df, by=["fold"], cost=loan_cost())


@query(
    "evl5_fold_summary",
    FOLDS
    + " union all ".join(
        f"select {i + 1} as place, '{m}' as metric, round(avg({m}), {0 if m in ('cost', 'tp', 'tn', 'fp', 'fn') else 4}) as mean, "
        f"round(stddev_pop({m}), {0 if m in ('cost', 'tp', 'tn', 'fp', 'fn') else 4}) as sd from folds"
        for i, m in enumerate(METRICS)
    ),
    loans=True,
)
def evl5(spark, folder):
    return ev.fold_summary(folds(spark, folder), METRICS)


MODELS = (
    ", given as (select *, 'half' as model, cast(p_default >= 0.5::double as int) as pred from scored"
    " union all select *, 'strict', cast(p_default >= 0.8::double as int) from scored"
    " union all select *, 'loose', cast(p_default >= 0.2::double as int) from scored)"
    f", runs as (select * from {metric_sql(f'(select model, loan_id % 5 as fold, {COUNTS_SQL}, {COST_SQL} from given group by 1, 2)')})\n"
)


def runs(spark, folder) -> DataFrame:
    base = tw.loss_columns(labelled_loans(spark, folder)).withColumn("fold", F.col("loan_id") % 5)
    cuts = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("cut")) for m, c in (("half", 0.5), ("strict", 0.8), ("loose", 0.2))])
    df = base.select("*", F.inline(cuts)).withColumn("pred", (F.col("p_default") >= F.col("cut")).cast("int"))
    return ev.evaluate(df, by=["model", "fold"], cost=loan_cost())


@query(
    "evl6_model_summary",
    MODELS
    + """select model, round(avg(bacc), 6) as bacc_mean, round(stddev_samp(bacc), 6) as bacc_sd,
      round(avg(cost), 2) as cost_mean, round(stddev_samp(cost), 2) as cost_sd from runs group by model""",
    loans=True,
)
def evl6(spark, folder):
    out = ev.model_summary(runs(spark, folder), ["bacc", "cost"])
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("bacc_mean", "bacc_sd")], *[F.round(c, 2).alias(c) for c in ("cost_mean", "cost_sd")])


@query(
    "evl7_comparison",
    MODELS
    + """select model, round(avg(bacc), 6) as bacc, round(avg(case when model = 'strict' then recall end), 6) as recall,
      round(avg(cost), 2) as cost from runs group by model""",
    loans=True,
)
def evl7(spark, folder):
    """Baselines carry no recall, the proposed method does."""
    both = runs(spark, folder)
    baselines = both.where("model <> 'strict'").select("model", "bacc", "cost")
    proposed = both.where("model = 'strict'").select("model", "bacc", "cost", "recall")
    out = ev.comparison(baselines, proposed, ["bacc", "recall", "cost"])
    return out.select("model", F.round("bacc", 6).alias("bacc"), F.round("recall", 6).alias("recall"), F.round("cost", 2).alias("cost"))


IMPORTANCE = """select event_type || '-' || (user_id % 7) as feature, avg(value) as importance, event_id % 5 as fold from events group by 1, 3"""


@query(
    "evl8_importance",
    f"""select feature, round(avg(importance), 6) as mean, round(stddev_samp(importance), 6) as sd from ({IMPORTANCE})
    group by feature order by avg(importance) desc, feature limit 20""",
)
def evl8(spark, folder):
    """Average event value per (event type, user group) stands in for a fold's feature importance."""
    e = table(spark, folder, "events")
    feature = F.concat("event_type", F.lit("-"), (F.col("user_id") % 7).cast("string")).alias("feature")
    given = e.groupBy(feature, (F.col("event_id") % 5).alias("fold")).agg(F.avg("value").alias("importance"))
    out = ev.importance_summary(given, 20)
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(
    "evl10_roc_points",
    """, c as (select p_default as score, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from scored group by 1)
    select score, round(sum(pos) over w / (select sum(pos) from c)::double, 6) as tpr, round(sum(neg) over w / (select sum(neg) from c)::double, 6) as fpr
    from c window w as (order by score desc)""",
    loans=True,
)
def evl10(spark, folder):
    return ev.roc_points(labelled_loans(spark, folder)).select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))
