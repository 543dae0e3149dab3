"""Feature elimination, and training several models the same way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, functions as F

from loantriad.models.learners import Learner, area, assemble, importances, score
from loantriad.operators.evaluate import evaluate
from loantriad.operators.sampling import stratified_k_fold
from loantriad.session import materialise, spread


@dataclass(frozen=True)
class Elimination:
    chosen: list[str]
    scores: dict[int, float]


def _order(train: DataFrame, test: DataFrame | None, columns: list[str], learner: Learner, scoring: str, stop: int):
    """Drop the least important feature again and again; yields (features, score on ``test``)."""
    left = list(columns)
    while True:
        model = learner().fit(assemble(train, left).select("y", "features"))
        value = None
        if test is not None:
            scored = score(model, assemble(test, left))
            if scoring == "auc":
                value = area(scored)
            else:
                value = scored.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
        yield list(left), value
        if len(left) <= stop:
            return
        ranked = sorted(importances(model, left), key=lambda p: (p[1], p[0]))
        left.remove(ranked[0][0])


def eliminate_features(
    df: DataFrame, row_id: str, columns: list[str], learner: Learner, folds: int = 5, scoring: str = "auc",
    protected: tuple[str, ...] = (), seed: int = 42,
) -> Elimination:
    """Recursive elimination with cross-validated choice of how many features to keep.

    The data are stored once and every fit reads the columns it needs. Ties go to fewer features.
    """
    keep = [row_id, "y", *columns]
    data = spread(materialise(stratified_k_fold(df.select(*keep), row_id, ["y"], folds, seed, "_fold"), "elimination"))
    totals: dict[int, float] = {}
    for fold in range(folds):
        train, test = data.where(F.col("_fold") != fold), data.where(F.col("_fold") == fold)
        for left, value in _order(train, test, columns, learner, scoring, 1):
            totals[len(left)] = totals.get(len(left), 0.0) + value / folds
    best = max(totals.values())
    size = min(n for n, v in totals.items() if v == best)
    chosen = list(columns)
    for left, _ in _order(data, None, columns, learner, scoring, size):
        chosen = left
    return Elimination([c for c in columns if c in chosen or c in protected], totals)


def train_and_evaluate(
    models: dict[str, Estimator], train: DataFrame, test: DataFrame, cost: Column | None = None, extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row of counts, scores, cost and AUC per model. ``train`` and ``test`` carry ``features`` and ``y``."""
    out = None
    for name, model in models.items():
        scored = score(model.fit(train), test)
        row = evaluate(scored, cost=cost).withColumns({"auc": F.lit(area(scored)), "model": F.lit(name), **(extra or {})})
        out = row if out is None else out.unionByName(row)
    return out
