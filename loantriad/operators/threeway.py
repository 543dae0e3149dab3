"""Three-way decisions: losses, per-loan thresholds, regions and costs.

Names used throughout: ``lam_pn`` is the loss of refusing a good loan, ``lam_np`` the loss of
accepting a default, ``u`` and ``v`` scale them into the loss of deferring. y = 1 is a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loantriad.functions.metrics import yearly_interest

VARIANTS = ("amount", "years", "product", "rate")


def loss_columns(
    df: DataFrame,
    variant: str = "years",
    principal: str = "loan_amount",
    rate: str = "loan_rate",
    years: str = "duration_years",
    interest: str | None = None,
) -> DataFrame:
    """Add ``lam_pn`` and ``lam_np``.

    amount: interest already in money; years: amount * rate / 100 * years;
    product: rate * principal; rate: the rate itself. The last two read NULL as 0.
    """
    capital = F.col(principal)
    if variant == "amount":
        gain = F.col(interest)
    elif variant == "years":
        gain = yearly_interest(capital, F.col(rate), F.col(years))
    elif variant in ("product", "rate"):
        capital = F.coalesce(capital, F.lit(0.0))
        pct = F.coalesce(F.col(rate), F.lit(0.0))
        gain = pct * capital if variant == "product" else pct
    else:
        raise ValueError(f"variant must be one of {VARIANTS}")
    return df.withColumns({"lam_pn": gain, "lam_np": capital + gain})


def upper_threshold(lam_pn: Column, lam_np: Column, u: Column, v: Column) -> Column:
    """alpha; 1 when every loss in it is zero."""
    keep = lam_pn - v * lam_pn
    return F.coalesce(F.try_divide(keep, keep + u * lam_np), F.lit(1.0))


def lower_threshold(lam_pn: Column, lam_np: Column, u: Column, v: Column) -> Column:
    """beta; 0 when every loss in it is zero."""
    defer = v * lam_pn
    return F.coalesce(F.try_divide(defer, defer + (lam_np - u * lam_np)), F.lit(0.0))


def with_thresholds(df: DataFrame, u: Column | float, v: Column | float, lift: bool = False) -> DataFrame:
    """Add ``alpha`` and ``beta``; ``lift`` raises alpha to beta where they cross."""
    u = u if isinstance(u, Column) else F.lit(float(u))
    v = v if isinstance(v, Column) else F.lit(float(v))
    pn, np_ = F.col("lam_pn"), F.col("lam_np")
    alpha, beta = upper_threshold(pn, np_, u, v), lower_threshold(pn, np_, u, v)
    return df.withColumns({"alpha": F.greatest(alpha, beta) if lift else alpha, "beta": beta})


def region(p: Column, alpha: Column, beta: Column) -> Column:
    """POS wins when both comparisons hold; a missing score (NULL or NaN) or threshold leaves BND."""
    p = F.nanvl(p.cast("double"), F.lit(None).cast("double"))
    return F.when(p >= alpha, "POS").when(p <= beta, "NEG").otherwise("BND")


def fixed_region(p: Column, alpha: float = 0.7, beta: float = 0.3) -> Column:
    return region(p, F.lit(alpha), F.lit(beta))


def expected_cost(where: Column, p: Column, lam_pn: Column, lam_np: Column, u: Column, v: Column) -> Column:
    return (
        F.when(where == "POS", lam_pn * (1 - p))
        .when(where == "NEG", lam_np * p)
        .otherwise(u * lam_np * p + v * lam_pn * (1 - p))
    )


def realised_cost(where: Column, y: Column, lam_pn: Column, lam_np: Column, u: Column, v: Column) -> Column:
    return (
        F.when(where == "POS", F.when(y == 0, lam_pn).otherwise(0.0))
        .when(where == "NEG", F.when(y == 1, lam_np).otherwise(0.0))
        .otherwise(F.when(y == 1, u * lam_np).otherwise(v * lam_pn))
    )


def binary_cost(pred: Column, y: Column, cost_fp: Column, cost_fn: Column) -> Column:
    """Cost of a two-way decision; the costs may be per-loan columns or literals."""
    return F.when((pred == 1) & (y == 0), cost_fp).when((pred == 0) & (y == 1), cost_fn).otherwise(0.0)


def decide(df: DataFrame, u: float, v: float, p: str = "p_default") -> DataFrame:
    """Add thresholds and ``region`` for one choice of scales."""
    out = with_thresholds(df, u, v)
    return out.withColumn("region", region(F.col(p), F.col("alpha"), F.col("beta")))


def decision_counts(df: DataFrame, by: str = "region") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def resolve_boundary(df: DataFrame, second: DataFrame, key: str = "loan_id") -> DataFrame:
    """Final 0/1 decision: POS is 1, NEG is 0, BND takes ``second.pred`` found by key.

    Every boundary loan needs a second opinion; one without keeps a NULL decision.
    """
    boundary = second.select(key, F.col("pred").alias("_second"))
    return (
        df.join(boundary, key, "left")
        .withColumn(
            "final_pred",
            F.when(F.col("region") == "POS", 1).when(F.col("region") == "NEG", 0).otherwise(F.col("_second")),
        )
        .drop("_second")
    )


def loss_matrix(df: DataFrame, u: float, v: float, key: str = "loan_id") -> DataFrame:
    """Three actions by two states per loan, as rows."""
    pn, np_ = F.col("lam_pn"), F.col("lam_np")
    zero = F.lit(0.0)
    lines = F.array(
        F.struct(F.lit("accept").alias("action"), zero.alias("loss_default"), pn.alias("loss_good")),
        F.struct(F.lit("defer").alias("action"), (u * np_).alias("loss_default"), (v * pn).alias("loss_good")),
        F.struct(F.lit("reject").alias("action"), np_.alias("loss_default"), zero.alias("loss_good")),
    )
    return df.select(key, F.inline(lines))
