"""Outlier fences, distribution tests, principal components."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from loantriad.operators.profile import moments, number
from loantriad.operators.ranks import percentiles, running_totals
from loantriad.session import settle


@dataclass(frozen=True)
class Fence:
    column: str
    q1: float
    q3: float
    lower: float
    upper: float


def iqr_fences(df: DataFrame, columns: list[str], factor: float = 1.5, method: str = "legacy") -> list[Fence]:
    marks = percentiles(df, columns, [0.25, 0.75], method)
    out = []
    for c in columns:
        q1, q3 = marks[c][0.25], marks[c][0.75]
        if q1 is None:
            continue
        gap = factor * (q3 - q1)
        out.append(Fence(c, q1, q3, q1 - gap, q3 + gap))
    return out


def is_outlier(fence: Fence) -> Column:
    x = number(fence.column)
    return (x < fence.lower) | (x > fence.upper)


def outlier_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sd, skewness, kurtosis, fences and number outside, per column."""
    fences = iqr_fences(df, columns)
    names = [f.column for f in fences]
    removed = df.agg(*[F.count_if(is_outlier(f)).alias(f.column) for f in fences]).first()
    spark = df.sparkSession
    bounds = spark.createDataFrame(
        [(f.column, f.q1, f.q3, f.lower, f.upper, removed[f.column]) for f in fences],
        "column string, q1 double, q3 double, lower double, upper double, removed bigint",
    )
    stats = moments(df, names).select("column", "mean", "sd", "skewness", "kurtosis")
    return stats.join(F.broadcast(bounds), "column")


def flag_outliers(df: DataFrame, columns: list[str], flag: str = "is_deleted") -> DataFrame:
    """Soft-delete flag: 1 where any column lies outside its fence."""
    outside = F.lit(False)
    for fence in iqr_fences(df, columns):
        outside = outside | F.coalesce(is_outlier(fence), F.lit(False))
    return df.withColumn(flag, outside.cast("int"))


def remove_outliers(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[tuple[Fence, int]]]:
    """Remove rows column by column, fences recomputed on what is left.

    The result is a plain filter over the input: earlier fences are literals, so no step has to be
    stored; each column reads that column and the ones already fenced, from a table stored first if
    ``df`` is costly.
    """
    kept, log = settle(df), []
    for c in columns:
        fences = iqr_fences(kept, [c])
        if not fences:
            continue
        outside = F.coalesce(is_outlier(fences[0]), F.lit(False))
        removed = kept.agg(F.count_if(outside).alias("n")).first().n
        log.append((fences[0], removed))
        kept = kept.where(~outside)
    return kept, log


def zscore_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows more than ``limit`` sample sd from the mean."""
    x = F.col(column).cast("double")
    mean, sd = df.agg(F.avg(x), F.stddev_samp(x)).first()
    if not sd:
        return df.where(F.lit(False))
    return df.where(F.abs((x - mean) / sd) > limit)


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value from the distance: 2 * sum (-1)^(j-1) exp(-2 j^2 t^2)."""
    t2 = d * d * (n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double"))
    steps = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        steps, F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * t2)
    )
    return F.when(t2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def ks_distance(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Largest gap between the distributions of two expressions over the same table: (d, n1, n2).

    Values are counted first, so a frequent value is one row, then prefix sums run over distinct values.
    """
    both = df.select(
        F.inline(F.array(F.struct(a.alias("x"), F.lit(1).alias("l"), F.lit(0).alias("r")), F.struct(b.alias("x"), F.lit(0).alias("l"), F.lit(1).alias("r"))))
    ).where("x is not null")
    counts = both.groupBy("x").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    summed = running_totals(counts, [F.col("x")], {"cl": "l", "cr": "r"})
    sizes = counts.agg(F.sum("l").alias("n1"), F.sum("r").alias("n2")).first()
    n1, n2 = F.lit(sizes.n1), F.lit(sizes.n2)
    gap = F.max(F.abs(F.col("cl") / n1 - F.col("cr") / n2))
    return summed.agg(gap.alias("d")).select("d", n1.alias("n1"), n2.alias("n2"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    # Coefficients of the published approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def ks_normal(df: DataFrame, x: Column, mean: float, sd: float) -> DataFrame:
    """One-sample distance of ``x`` from N(mean, sd): (d, n1, n2) with n2 unbounded."""
    counts = df.select(x.alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    summed = running_totals(counts, [F.col("x")], {"c": "k"})
    n = counts.agg(F.sum("k")).first()[0]
    cdf = normal_cdf((F.col("x") - mean) / sd)
    gap = F.greatest(F.abs(F.col("c") / n - cdf), F.abs((F.col("c") - F.col("k")) / n - cdf))
    return summed.agg(F.max(gap).alias("d")).select("d", F.lit(n).alias("n1"), F.lit(2**52).cast("bigint").alias("n2"))


def distribution_report(df: DataFrame, column: str, compat: bool = True) -> DataFrame:
    """Moments, KS distance and p-value, normality verdict and the outlier method that follows from it.

    ``compat`` compares z-scores with raw values and excess kurtosis with 3, as the original rule does;
    otherwise excess kurtosis is compared with 0 and the values with N(mean, sd).
    """
    x = F.col(column).cast("double")
    df = settle(df.select(column))
    stats = moments(df, [column]).drop("rows", "variance")
    first = stats.first()
    if first is None or first.n == 0:
        raise ValueError(f"no values in {column}")
    mean, sd = first["mean"], first["sd"] or 1.0
    ks = ks_distance(df, (x - mean) / sd, x) if compat else ks_normal(df, x, mean, sd)
    p = kolmogorov_p(F.col("d"), F.col("n1"), F.col("n2"))
    row = df.sparkSession.createDataFrame([first], stats.schema)
    centre = 3.0 if compat else 0.0
    tested = ks.select(F.lit(column).alias("column"), F.col("d").alias("ks_d"), p.alias("ks_p"))
    normal = (F.abs("skewness") < 1.0) & (F.abs(F.col("kurtosis") - centre) < 1.0) & (F.col("ks_p") > 0.05)
    return (
        row.join(tested, "column")
        .withColumn("is_normal", F.coalesce(normal, F.lit(False)))
        .withColumn("method", F.when(F.col("is_normal"), "Z-Score").otherwise("IQR"))
    )


def fit_components(df: DataFrame, columns: list[str], k: int):
    """Principal components of centred columns. Returns (model, centred table with vector ``features``).

    A row with a missing value has no place in the space and is left out; fill it before to keep it.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = df.select("*", *[(F.col(c) - F.lit(means[c])).alias(f"_c_{c}") for c in columns])
    vectors = VectorAssembler(inputCols=[f"_c_{c}" for c in columns], outputCol="features").transform(
        centred.dropna(subset=columns)
    ).drop(*[f"_c_{c}" for c in columns])
    return PCA(k=k, inputCol="features", outputCol="components").fit(vectors), vectors


def explained_variance(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    model, _ = fit_components(df, columns, k)
    rows, total = [], 0.0
    for i, share in enumerate(model.explainedVariance.toArray(), 1):
        total += float(share)
        rows.append((i, float(share), total))
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def project(df: DataFrame, columns: list[str], k: int, keys: list[str]) -> DataFrame:
    model, vectors = fit_components(df, columns, k)
    parts = vector_to_array("components")
    return model.transform(vectors).select(*keys, *[parts[i].alias(f"pc{i + 1}") for i in range(k)])
