"""Scores computed from counts. A zero denominator gives 0."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * precision * recall, b2 * precision + recall)


def g_mean(tpr: Column, tnr: Column) -> Column:
    return F.sqrt(tpr * tnr)


def yearly_interest(amount: Column, rate_pct: Column, years: Column) -> Column:
    return amount * (rate_pct / 100.0) * years
