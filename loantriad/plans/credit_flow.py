"""The composed flow: fold, balance, score, search thresholds, decide, resolve the boundary, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from loantriad.functions.dates import days_since_origin
from loantriad.models.ensembles import BaggingClassifier, StackingClassifier
from loantriad.models.histograms import HistogramForest, eliminate_together
from loantriad.models.learners import Learner, area, assemble, decision_tree, gradient_boosting, importances, logistic, score
from loantriad.models.selection import eliminate_features, train_and_evaluate
from loantriad.operators import search as sr
from loantriad.operators import threeway as tw
from loantriad.operators.clean import impute
from loantriad.operators.evaluate import comparison, evaluate
from loantriad.operators.neighbors import smote
from loantriad.operators.sampling import stratified_k_fold
from loantriad.plans.loans import labelled_loans
from loantriad.plans.prepare import Roles, feature_names, prepare
from loantriad.session import materialise, settle, spread

FEATURES = ["loan_amount", "loan_rate", "duration_years", "installment_number", "monthly_income", "loan_days", "branch_code"]


def model_table(spark: SparkSession, folder: str, folds: int = 5) -> DataFrame:
    """Labelled, priced, imputed loans with a stratified fold, stored once for the many passes of training."""
    df = tw.loss_columns(labelled_loans(spark, folder)).withColumn("loan_days", days_since_origin(F.col("loan_date")))
    df = settle(df.select("loan_id", "y", "lam_pn", "lam_np", *FEATURES), "loans")
    return spread(materialise(stratified_k_fold(impute(df, ["monthly_income"]), "loan_id", ["y"], folds), "model-table"))


def prepared_table(raw: DataFrame, roles: Roles = Roles(), folds: int = 5, **options) -> tuple[DataFrame, list[str]]:
    """(model table, features) of a raw loan table through the composed preprocessing; the losses come from its own interest."""
    out = prepare(raw, roles, **options)
    losses = {"lam_pn": F.col("interest_cash"), "lam_np": F.col(roles.amount) + F.col("interest_cash")}
    stored = stratified_k_fold(out.withColumns(losses), roles.row_id, [roles.label], folds)
    return spread(materialise(stored, "prepared-table")), feature_names(out, roles)


@dataclass
class Settings:
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    risk: Learner = lambda: gradient_boosting(100, 0.05)
    boundary_tree: Learner = lambda: decision_tree(weight="copies")
    boundary_bags: int = 10
    balance: bool = True
    resolver: str = "bagging"  # or "forest" (bags grown together), or "stacking"
    stacked: dict[str, Learner] = field(default_factory=lambda: {"tree": lambda: decision_tree(depth=5), "logistic": lambda: logistic(100)})
    eliminate: Learner | None = None
    together: bool = False  # eliminate by forests that grow on all inner folds at once
    protected: tuple[str, ...] = ()
    eps: float = sr.STRICT
    steps: int = 20
    rounds: int = 1
    rule: str = "boundary"
    folds: int = 5


def fold_rows(data: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)


def resolver(cfg: Settings, names: list[str]) -> Estimator:
    """Second-stage model for the boundary."""
    if cfg.resolver == "bagging":
        return BaggingClassifier(cfg.boundary_tree, names, "loan_id", cfg.boundary_bags)
    if cfg.resolver == "stacking":
        return StackingClassifier(cfg.stacked, names, "loan_id", folds=cfg.folds)
    if cfg.resolver == "forest":
        return HistogramForest(cfg.boundary_bags)
    raise ValueError("resolver must be bagging, forest or stacking")


def run_fold(data: DataFrame, fold: int, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """(metrics row, feature importances) of one fold. Losses always come from the loan's own row."""
    train, test = fold_rows(data, fold)
    names = cfg.features
    if cfg.together:
        names = eliminate_together(train, "loan_id", names, cfg.folds, protected=cfg.protected)[0]
    elif cfg.eliminate is not None:
        names = eliminate_features(train, "loan_id", names, cfg.eliminate, cfg.folds, protected=cfg.protected).chosen
    fitted_on = train.select("loan_id", "y", *names)
    if cfg.balance:
        fitted_on = spread(materialise(smote(fitted_on, "loan_id", "y", names), "balanced"))
    risk = cfg.risk().fit(assemble(fitted_on, names).select("y", "features"))
    scored = spread(materialise(score(risk, assemble(test, names)).drop("features", "pred"), "scored"))

    _, (u, v) = sr.search(scored, cfg.steps, cfg.rounds, cfg.rule, cfg.eps, p="prob")
    decided = tw.decide(scored, u, v, p="prob")
    unsure = decided.where(F.col("region") == "BND").drop("prob")
    second = resolver(cfg, names).fit(assemble(train, names)).transform(assemble(unsure, names)).select("loan_id", "pred")

    before = tw.realised_cost(F.col("region"), F.col("y"), F.col("lam_pn"), F.col("lam_np"), F.lit(u), F.lit(v))
    final = tw.resolve_boundary(decided, second).withColumns({"before": before, "pred": F.col("final_pred")})
    final = materialise(final.select("y", "region", "before", "pred", "lam_pn", "lam_np"), "decided")
    after = tw.binary_cost(F.col("pred"), F.col("y"), F.col("lam_pn"), F.col("lam_np"))
    sums = final.agg(F.sum("before").alias("cost_before"), F.count_if(F.col("region") == "BND").alias("bnd")).first()
    row = evaluate(final, cost=after).withColumns(
        {
            "fold": F.lit(fold), "u": F.lit(u), "v": F.lit(v), "auc": F.lit(area(scored)),
            "cost_before": F.lit(sums.cost_before), "bnd": F.lit(sums.bnd),
        }
    )
    weights = [(f, w, fold) for f, w in importances(risk, names)]
    return row, data.sparkSession.createDataFrame(weights, "feature string, importance double, fold int")


def cross_validated(data: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """Metrics and importances of every fold. ``data`` has loan_id, y, fold, lam_pn, lam_np and the features.

    Folds are independent and mostly wait for small jobs, so they run side by side.
    """
    rows, weights = None, None
    one = inheritable_thread_target(data.sparkSession)(lambda fold: run_fold(data, fold, cfg))
    with ThreadPool(cfg.folds) as pool:
        found = pool.map(one, range(cfg.folds))
    for row, weight in found:
        rows = row if rows is None else rows.unionByName(row)
        weights = weight if weights is None else weights.unionByName(weight)
    return materialise(rows, "folds"), weights


def baselines(data: DataFrame, models: dict[str, Learner], cfg: Settings) -> DataFrame:
    """Metrics of single-stage models on the same folds, which run side by side as those of ``cross_validated`` do."""
    cost = tw.binary_cost(F.col("pred"), F.col("y"), F.col("lam_pn"), F.col("lam_np"))

    def one(fold: int) -> DataFrame:
        train, test = (assemble(part, cfg.features) for part in fold_rows(data, fold))
        made: dict[str, Estimator] = {name: make() for name, make in models.items()}
        return materialise(train_and_evaluate(made, train, test, cost, {"fold": F.lit(fold)}), "baseline")

    out = None
    with ThreadPool(cfg.folds) as pool:
        for rows in pool.map(inheritable_thread_target(data.sparkSession)(one), range(cfg.folds)):
            out = rows if out is None else out.unionByName(rows)
    return materialise(out, "baselines")


METRICS = ["bacc", "auc", "fm", "gm", "recall", "cost", "tp", "tn", "fp", "fn"]


def compare(baseline_rows: DataFrame, proposed_rows: DataFrame) -> DataFrame:
    """Means per method, best balanced accuracy first; baselines report no recall."""
    shown = ["model", *METRICS]
    theirs = baseline_rows.select(*[c for c in shown if c != "recall"])
    ours = proposed_rows.withColumn("model", F.lit("Proposed")).select(*shown)
    return comparison(theirs, ours, METRICS)
