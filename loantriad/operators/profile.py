"""Column profiles: moments, counts, distributions.

One aggregate covers all columns; its single row is turned into one row per column afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loantriad.functions.parsing import cut
from loantriad.operators.ranks import percentiles
from loantriad.session import settle


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def bias_corrected(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Sample skewness and excess kurtosis from the population ones; NULL when too few values."""
    n = n.cast("double")
    g1 = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return g1, g2


def per_column(df: DataFrame, columns: list[str], make, labels: dict[str, str] | None = None) -> DataFrame:
    """``make(column)`` returns named aggregates; the result has one row per column."""
    labels = labels or {}
    packed = [F.struct(*make(c)).alias(c) for c in columns]
    wide = df.agg(*packed)
    rows = F.array(*[F.struct(F.lit(labels.get(c, c)).alias("column"), F.col(c).alias("s")) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.column", "r.s.*")


def number(c: str) -> Column:
    """The column as a double; NaN is missing, as in the tables' own loaders."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _moments(c: str) -> list[Column]:
    x = number(c)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.var_samp(x).alias("variance"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.skewness(x).alias("_g1"),
        F.kurtosis(x).alias("_g2"),
    ]


def moments(df: DataFrame, columns: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """rows, n, mean, sd, variance, min, max, skewness and kurtosis (bias corrected) per column."""
    out = per_column(df, columns, _moments, labels)
    g1, g2 = bias_corrected(F.col("n"), F.col("_g1"), F.col("_g2"))
    return out.withColumns({"skewness": g1, "kurtosis": g2}).drop("_g1", "_g2")


def as_text(df: DataFrame, column: str) -> Column:
    """Value as text, with one text for both zeros of a floating column."""
    fraction = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return (number(column) + F.lit(0.0)).cast("string") if fraction else F.col(column).cast("string")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct non-NULL values per column, counted from (column, value) groups."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in columns])
    cells = df.select(F.inline(pairs))
    seen = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("column").agg(F.count("value").alias("distinct"))


def describe(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Mean, sd, CV, median, min, max, range, IQR, skew, kurtosis, missing % and distinct, rounded."""
    df = settle(df.select(*columns))
    marks = percentiles(df, columns, [0.25, 0.5, 0.75])
    spark = df.sparkSession
    quart = spark.createDataFrame(
        [(c, marks[c][0.25], marks[c][0.5], marks[c][0.75]) for c in columns], "column string, q1 double, median double, q3 double"
    )
    base = moments(df, columns).join(F.broadcast(quart), "column").join(distinct_counts(df, columns), "column", "left")
    shown = {
        "mean": F.col("mean"), "sd": F.col("sd"), "cv": F.try_divide(F.col("sd"), F.col("mean")), "median": F.col("median"),
        "min": F.col("min"), "max": F.col("max"), "range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1"),
        "skew": F.col("skewness"), "kurt": F.col("kurtosis"),
        "missing_pct": 100.0 * (F.col("rows") - F.col("n")) / F.col("rows"),
    }
    return base.select("column", *[F.round(x, digits).alias(k) for k, x in shown.items()], F.coalesce("distinct", F.lit(0)).alias("distinct"))


def attribute_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count with missing, mean, sd, variance, min, max, range, missing and distinct."""
    base = moments(df, columns).join(distinct_counts(df, columns), "column", "left")
    return base.select(
        "column", F.col("rows").alias("count"), "mean", "sd", "variance", "min", "max",
        (F.col("max") - F.col("min")).alias("range"), (F.col("rows") - F.col("n")).alias("missing"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
    )


def mixed_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Summary of columns of any type, values as text where the type varies.

    Numbers: min, max, range, mean, variance, sd. Dates: min, max, range in days, mean date. Others: min, max.
    """
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}

    def make(c: str) -> list[Column]:
        x, kind = F.col(c), types[c]
        none = F.lit(None).cast("double")
        low, high = F.min(x).cast("string"), F.max(x).cast("string")
        span = mean = var = sd = none
        mean_text = F.lit(None).cast("string")
        if isinstance(kind, T.NumericType):
            d = x.cast("double")
            low, high = F.min(d).cast("string"), F.max(d).cast("string")
            span, mean, var, sd = F.max(d) - F.min(d), F.avg(d), F.var_samp(d), F.stddev_samp(d)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            day = F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date"))
            low, high = F.min(x.cast("date")).cast("string"), F.max(x.cast("date")).cast("string")
            span = (F.max(day) - F.min(day)).cast("double")
            mean_text = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.avg(day)).cast("int")).cast("string")
        return [
            F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), low.alias("min"), high.alias("max"),
            span.alias("range"), mean.alias("mean"), mean_text.alias("mean_date"), var.alias("variance"), sd.alias("sd"),
        ]

    base = per_column(df, columns, make)
    return base.join(distinct_counts(df, columns), "column", "left").select(
        "column", F.coalesce("distinct", F.lit(0)).alias("distinct"), (F.col("rows") - F.col("n")).alias("missing"),
        "min", "max", "range", "mean", "mean_date", "variance", "sd",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percentage of the columns that miss anything."""
    columns = columns or df.columns
    out = per_column(df, columns, lambda c: [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("missing")])
    return out.where("missing > 0").select(
        "column", "missing", F.round(100.0 * F.col("missing") / F.col("rows"), 2).alias("missing_pct")
    )


def useless_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose cell is NULL, blank text or numeric zero, per column."""
    columns = columns or df.columns
    numbers = set(numeric_columns(df))

    def make(c: str) -> list[Column]:
        x = F.col(c)
        empty = (x == 0) if c in numbers else (cut(x.cast("string")) == "")
        return [F.count(F.lit(1)).alias("total_rows"), F.count_if(x.isNull() | empty).alias("useless_count")]

    pct = F.round(100.0 * F.col("useless_count") / F.col("total_rows"), 2)
    return per_column(df, columns, make).withColumn("useless_percentage", pct)


def top_variance(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    out = per_column(df, columns, lambda c: [F.var_samp(F.col(c).cast("double")).alias("variance")])
    return out.where("variance is not null").orderBy(F.desc("variance"), "column").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 20, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the least and greatest value; share of rows and density per group.

    The range is one pass, the counts another; at most ``bins`` rows per group are shuffled per task.
    """
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins
    place = F.when(F.lit(width) == 0, 0).otherwise(F.least(F.floor((x - low) / F.lit(width or 1.0)), F.lit(bins - 1))).cast("int")
    keys = by or []
    counts = df.where(x.isNotNull()).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    share = F.col("n") / F.sum("n").over(group)  # over the bin counts, a bounded table
    return counts.select(
        *keys, "bin", (low + F.col("bin") * width).alias("start"), "n", share.alias("share"),
        (F.try_divide(share, F.lit(width))).alias("density"),
    )
