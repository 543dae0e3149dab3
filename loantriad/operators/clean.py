"""Column cleaning: drop, fill, convert, scale. Decisions come from one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loantriad.functions.dates import days_since_origin, epoch_seconds
from loantriad.operators.encode import encode_labels
from loantriad.operators.profile import number, numeric_columns
from loantriad.operators.ranks import percentiles

MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else F.col(c) for c in df.columns])


def present_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    row = nan_to_null(df).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns]).first()
    return row["_rows"], {c: row[c] for c in df.columns}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    _, present = present_counts(df)
    return df.drop(*[c for c, n in present.items() if n == 0])


def drop_sparse_columns(df: DataFrame, share: float = 0.2) -> DataFrame:
    rows, present = present_counts(df)
    return df.drop(*[c for c, n in present.items() if n < int(share * rows)])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop columns with exactly one distinct present value: least equals greatest, no distinct needed."""
    row = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if row[c].a is not None and row[c].a == row[c].b])


def drop_low_variance(df: DataFrame, floor: float = 1e-4, columns: list[str] | None = None) -> DataFrame:
    names = columns or numeric_columns(df)
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if row[c] is not None and row[c] < floor])


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent present value per column, ties to the smallest."""
    if not columns:
        return {}
    numbers = set(numeric_columns(df))
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("x"),
            F.col(c).cast("string").alias("value"),
        )
        for c in columns
    ]
    counts = df.select(F.inline(F.array(*cells))).where("value is not null").groupBy("column", "x", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by(F.struct("x", "value"), F.struct(-F.col("n"), "x", "value")).alias("m")).collect()
    return {r.column: (r.m.x if r.column in numbers else r.m.value) for r in best}


def means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    row = df.agg(*[F.avg(number(c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    marks = percentiles(df, columns, [0.5]) if columns else {}
    return {c: marks[c][0.5] for c in columns}


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace NULL (and NaN) by the given value; a filled numeric column becomes double."""
    out = []
    for c in df.columns:
        value = values.get(c)
        if value is None:
            out.append(F.col(c))
        elif isinstance(value, float):
            out.append(F.coalesce(number(c), F.lit(value)).alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.lit(value)).alias(c))
    return df.select(*out)


def impute(df: DataFrame, columns: list[str], strategy: str = "mean") -> DataFrame:
    finders = {"mean": means, "median": medians, "most_frequent": modes}
    if strategy not in finders:
        raise ValueError(f"strategy must be one of {sorted(finders)}")
    return fill(df, finders[strategy](df, columns))


def fill_mean_or_mode(df: DataFrame) -> DataFrame:
    """Mean for numbers, most frequent value for the rest."""
    numbers = numeric_columns(df)
    rest = [c for c in df.columns if c not in numbers]
    return fill(df, {**means(df, numbers), **modes(df, rest)})


def fill_by_missing_share(df: DataFrame, low: float = 5.0, high: float = 20.0) -> DataFrame:
    """Missing below ``low`` percent: mean (mode for text); below ``high``: median; else drop the column.

    Text between the two limits has no median and takes its mode.
    """
    rows, present = present_counts(df)
    numbers = set(numeric_columns(df))
    share = {c: 100.0 * (rows - n) / rows for c, n in present.items() if n < rows}
    dropped = [c for c, s in share.items() if s >= high]
    by_mean = [c for c, s in share.items() if s < low and c in numbers]
    by_median = [c for c, s in share.items() if low <= s < high and c in numbers]
    by_mode = [c for c, s in share.items() if s < high and c not in numbers]
    return fill(df.drop(*dropped), {**means(df, by_mean), **medians(df, by_median), **modes(df, by_mode)})


def coerce_numbers(df: DataFrame, columns: list[str], constants: dict[str, float] | None = None) -> DataFrame:
    """Text to number, failures to the column mean. ``constants`` fills instead, and adds an absent column."""
    constants = constants or {}
    typed = df.withColumns({c: F.col(c).try_cast("double") for c in [*columns, *constants] if c in df.columns})
    typed = typed.withColumns({c: F.lit(v) for c, v in constants.items() if c not in df.columns})
    return fill(typed, {**means(typed, columns), **{c: float(v) for c, v in constants.items()}})


def date_number(column: Column, unit: str) -> Column:
    return days_since_origin(column) if unit == "days" else epoch_seconds(column)


def convert_columns(df: DataFrame, unit: str = "days", null_text: str = "None") -> DataFrame:
    """Every column to a number: dates by ``unit``; text that always parses as double; other text as codes."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    coded: list[str] = []
    if texts:
        bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]).first()
        coded = [c for c in texts if bad[c] > 0]
    out = encode_labels(df, coded, null_text) if coded else df
    typed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, MOMENTS):
            typed[f.name] = date_number(F.col(f.name), unit)
        elif f.name in texts and f.name not in coded:
            typed[f.name] = F.col(f.name).try_cast("double")
    return out.withColumns(typed) if typed else out


def fill_date_seconds(df: DataFrame, column: str, out: str) -> DataFrame:
    """Date column replaced by epoch seconds, missing ones by the median."""
    typed = df.withColumn(out, epoch_seconds(F.col(column))).drop(column)
    middle = medians(typed, [out])[out]
    return fill(typed, {out: middle})


def scale_stats(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """Fitted scaling: one row per column, (column, mean, sd). Population sd unless ``sample``."""
    sd = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("m"), sd(F.col(c).cast("double")).alias("s")).alias(c) for c in columns]).first()
    return df.sparkSession.createDataFrame([(c, row[c].m, row[c].s) for c in columns], "column string, mean double, sd double")


def apply_scale(df: DataFrame, stats: DataFrame) -> DataFrame:
    """z-scores with fitted statistics; a constant column becomes 0."""
    fitted = {r["column"]: (r["mean"], r["sd"]) for r in stats.collect()}  # one row per column
    return df.withColumns({c: (F.col(c).cast("double") - m) / (s if s else 1.0) for c, (m, s) in fitted.items() if m is not None})


def standardize(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    names = [c for c in numeric_columns(df) if c not in exclude]
    return apply_scale(df, scale_stats(df, names))


def standardize_if_spread(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Scale every numeric column (sample sd) when any has sd above ``factor`` times its mean."""
    names = columns or numeric_columns(df)
    stats = scale_stats(df, names, sample=True)
    spread = stats.where(F.col("sd") > factor * F.col("mean")).limit(1).count()
    return apply_scale(df, stats) if spread else df
