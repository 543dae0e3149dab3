"""Evaluation of decisions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loantriad.functions.metrics import f_beta, g_mean, ratio
from loantriad.operators.ranks import running_totals

COUNTS = ("tp", "tn", "fp", "fn")


def confusion_aggs(y: str = "y", pred: str = "pred") -> list[Column]:
    t, p = F.col(y), F.col(pred)

    def count(a: int, b: int, name: str) -> Column:
        return F.count(F.when((t == a) & (p == b), 1)).alias(name)

    return [count(1, 1, "tp"), count(0, 0, "tn"), count(0, 1, "fp"), count(1, 0, "fn")]


def metric_columns(beta: float = 1.0) -> dict[str, Column]:
    """Scores from columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return {
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "bacc": (recall + specificity) / 2,
        "fm": f_beta(precision, recall, beta),
        "gm": g_mean(recall, specificity),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
    }


def evaluate(
    df: DataFrame,
    y: str = "y",
    pred: str = "pred",
    by: list[str] | None = None,
    cost: Column | None = None,
    beta: float = 1.0,
) -> DataFrame:
    """Counts, scores and (with ``cost``) total cost in one aggregate, per group if asked."""
    aggs = confusion_aggs(y, pred)
    if cost is not None:
        aggs.append(F.sum(cost).alias("cost"))
    return df.groupBy(*(by or [])).agg(*aggs).withColumns(metric_columns(beta))


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: a hot score becomes one row."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg")
    )


def auc(df: DataFrame, y: str = "y", score: str = "p_default") -> DataFrame:
    """Exact area under the ROC curve with ties at one half; NULL when a class is absent."""
    counts = score_counts(df.where(F.col(score).isNotNull()), y, score)
    summed = running_totals(counts, [F.col("score")], {"neg_upto": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return summed.agg(F.try_divide(wins, pairs).alias("auc"))


def roc_points(df: DataFrame, y: str = "y", score: str = "p_default") -> DataFrame:
    """True and false positive rate when everything at or above each distinct score is called positive."""
    counts = score_counts(df.where(F.col(score).isNotNull()), y, score)
    summed = running_totals(counts, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    totals = counts.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    one_row = totals.first()
    return summed.select(
        "score",
        F.try_divide(F.col("tp").cast("double"), F.lit(float(one_row._p or 0))).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.lit(float(one_row._n or 0))).alias("fpr"),
    )


def class_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class. Works on the class-pair counts only."""
    pairs = class_counts(df, y, pred)
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                         F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    total = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    precision, recall = ratio(F.col("hit"), F.col("called")), ratio(F.col("hit"), F.col("support"))
    return total.select(
        "class", "support", precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall).alias("f1")
    )


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population sd per metric over folds, kept in the given metric order."""
    whole = F.col("metric").isin(*COUNTS, "cost")
    mean, sd = F.avg("value"), F.stddev_pop("value")
    long = to_long(folds.select(*metrics), [], metrics)
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric")).cast("int")
    return (
        long.groupBy("metric").agg(mean.alias("mean"), sd.alias("sd"))
        .select(
            place.alias("place"),
            "metric",
            F.when(whole, F.round("mean", 0)).otherwise(F.round("mean", 4)).alias("mean"),
            F.when(whole, F.round("sd", 0)).otherwise(F.round("sd", 4)).alias("sd"),
        )
        .orderBy("place")
    )


def model_summary(results: DataFrame, metrics: list[str], by: str = "model") -> DataFrame:
    """Mean and sample sd per model, cheapest first."""
    aggs = [f(F.col(m)).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
    out = results.groupBy(by).agg(*aggs)
    return out.orderBy("cost_mean") if "cost" in metrics else out


def comparison(baselines: DataFrame, proposed: DataFrame, metrics: list[str], by: str = "model") -> DataFrame:
    """Means per method, baselines and the proposed flow together; a metric one side lacks is NULL."""
    both = baselines.unionByName(proposed, allowMissingColumns=True)
    return both.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics]).orderBy(F.desc("bacc"))


def importance_summary(importances: DataFrame, top: int = 20) -> DataFrame:
    """Mean and sample sd of feature importance over folds, the ``top`` largest."""
    return (
        importances.groupBy("feature")
        .agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("sd"))
        .orderBy(F.desc("mean"), "feature")
        .limit(top)
    )
