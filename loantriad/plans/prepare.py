"""The composed preprocessing of the flow: from a raw loan table to numbers that models take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loantriad.functions.labels import GOOD_STATUSES, label_from_good
from loantriad.functions.metrics import yearly_interest
from loantriad.operators.clean import drop_empty_columns, drop_sparse_columns, fill, fill_date_seconds, means, modes
from loantriad.operators.correlation import correlated_columns
from loantriad.operators.encode import one_hot, one_hot_vector
from loantriad.operators.filters import non_negative
from loantriad.operators.profile import numeric_columns
from loantriad.session import settle


@dataclass(frozen=True)
class Roles:
    """Which column plays which part; ``date`` may be missing from the table."""

    row_id: str = "loan_id"
    status: str = "status"
    amount: str = "loan_amount"
    rate: str = "loan_rate"
    years: str = "duration_years"
    instalments: str = "installment_number"
    date: str = "loan_date"
    label: str = "y"
    good: tuple[str, ...] = tuple(GOOD_STATUSES)


def labelled(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Empty columns dropped, label from the status, amount and instalments as numbers of at least 0, others dropped.

    A rate that is no number takes the mean rate of the rows that stay; the yearly interest counts unknown years as one.
    """
    out = drop_empty_columns(df)
    out = out.withColumn(roles.label, label_from_good(F.col(roles.status), roles.good))
    out = non_negative(out, [roles.amount, roles.instalments])
    out = out.withColumns({c: F.col(c).try_cast("double") for c in (roles.amount, roles.instalments, roles.rate)})
    out = fill(out, means(out, [roles.rate]))
    years = F.coalesce(F.col(roles.years).try_cast("double"), F.lit(1.0)) if roles.years in out.columns else F.lit(1.0)
    return out.withColumn("interest_cash", yearly_interest(F.col(roles.amount), F.col(roles.rate), years))


def prepare(
    df: DataFrame, roles: Roles = Roles(), threshold: float = 0.7, share: float = 0.2, vector: str | None = None
) -> DataFrame:
    """Row id, label and features of a raw loan table; with ``vector`` also one sparse column of that name.

    Steps, in this order: ``labelled``; of numeric columns that correlate beyond ``threshold`` the later one goes (the id,
    the label and the interest take no part; amount and rate mark others, but stay); columns with fewer than ``share``
    of their cells go; the date becomes seconds, unknown ones the median; missing numbers take the mean, missing texts the most
    frequent value; texts become 0/1 columns, the first value left out. ``vector`` leaves texts as they are and has no limit of values.
    A table without rows gives the id and the label alone. Ids are never rounded.
    """
    raw = settle(df, "raw-loans")
    if raw.limit(1).count() == 0:
        return raw.select(roles.row_id, F.lit(None).cast("int").alias(roles.label))
    out = settle(labelled(raw, roles), "labelled-loans")
    own = (roles.row_id, roles.label)
    marked = correlated_columns(out, [c for c in numeric_columns(out) if c not in (*own, "interest_cash")], threshold)
    out = out.drop(*[c for c in marked if c not in (roles.amount, roles.rate)], roles.status)
    out = out.select(*own, *drop_sparse_columns(out.drop(*own), share).columns)
    if roles.date in out.columns:
        out = fill_date_seconds(out, roles.date, f"{roles.date}_seconds")
    numbers = feature_names(out, roles)
    texts = [c for c in out.columns if c not in (*own, *numbers)]
    out = out.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else out
    out = fill(out, {**means(out, numbers), **modes(out, texts)})
    return one_hot_vector(out, texts, numbers, vector) if vector else one_hot(out, texts)


def feature_names(prepared: DataFrame, roles: Roles = Roles()) -> list[str]:
    return [c for c in numeric_columns(prepared) if c not in (roles.row_id, roles.label)]
