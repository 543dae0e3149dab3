"""Loan tables from CSV folders, databases and metadata-driven projections."""

from __future__ import annotations

from loantriad.functions.parsing import cut
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loantriad.functions import parsing as ps
from loantriad.sources.records import parse_records, read_records
from loantriad.sources.schemas import BANK, MARKETPLACE


def _cell(column: Column, kind: str, month_dates: bool, lenient: bool) -> Column:
    if kind == "int":
        return ps.parse_int(column, lenient)
    if kind == "bigint":
        return ps.parse_long(column)
    if kind.startswith("decimal"):
        precision, scale = kind[8:-1].split(",")
        return ps.parse_decimal(column, int(precision), int(scale))
    if kind == "float":
        return ps.parse_float(column)
    if kind == "date":
        return ps.parse_month_year(column) if month_dates else ps.parse_date(column)
    if kind == "timestamp":
        return ps.parse_timestamp(column)
    if kind == "char":
        return ps.parse_char(column)
    return ps.clean_quotes(ps.blank_to_null(column))


def read_positional_csv(
    spark: SparkSession, folder: str, columns: list[tuple[str, str]], month_dates: bool = False, lenient: bool = False,
    line_breaks: bool = True,
) -> DataFrame:
    """Every ``*.csv`` directly in ``folder``. Cells go to columns by position; the header is skipped.

    Short rows end in NULLs, extra cells are dropped, cells that do not parse are NULL. Large files are read by
    many tasks, also where quoted cells hold line breaks (``sources.records``, two passes); ``line_breaks=False``
    saves the first pass for files known to have none.
    """
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    if line_breaks:
        cells = parse_records(read_records(spark, folder), raw)
    else:
        cells = (
            spark.read.schema(raw)
            .option("header", True)
            .option("enforceSchema", True)
            .option("mode", "PERMISSIVE")
            .option("escape", '"')
            .option("pathGlobFilter", "*.csv")
            .csv(folder)
        )
    return cells.select(
        *[_cell(F.col(f"c{i}"), kind, month_dates, lenient).alias(name) for i, (name, kind) in enumerate(columns)]
    )


def read_marketplace_csv(spark: SparkSession, folder: str, line_breaks: bool = True) -> DataFrame:
    """151-column files: ``Dec-2015`` dates, integers may be written as decimals."""
    return read_positional_csv(spark, folder, MARKETPLACE, month_dates=True, lenient=True, line_breaks=line_breaks)


def read_bank_csv(spark: SparkSession, folder: str, line_breaks: bool = True) -> DataFrame:
    """51-column files: ISO dates and times, strict integers."""
    return read_positional_csv(spark, folder, BANK, line_breaks=line_breaks)


def read_class_file(spark: SparkSession, path: str, classes: list[str], fields: int = 4) -> DataFrame:
    """Headerless lines of ``fields`` numbers and a class name; other lines are skipped.

    The class becomes its 0-based place in ``classes``, NULL when it is not listed.
    """
    parts = F.split("value", ",")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == fields + 1)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), cut(F.col("p")[fields])).cast("int")
    return lines.select(
        *[cut(F.col("p")[i]).try_cast("double").alias(f"feature{i + 1}") for i in range(fields)],
        F.when(place > 0, place - 1).alias("class_index"),
    )


def read_jdbc(
    spark: SparkSession,
    url: str,
    source: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    excluded: tuple[str, ...] = (),
    **options: str,
) -> DataFrame:
    """Database table in one scan, split over executors by ranges of ``key`` instead of sorted pages."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**options)
    if key and bounds:
        reader = (
            reader.option("partitionColumn", key)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load().drop(*excluded)


def fetch(df: DataFrame, limit: int | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``limit`` rows in no particular order, without the excluded columns."""
    out = df.drop(*excluded)
    return out if limit is None else out.limit(limit)


def fetch_latest(df: DataFrame, key: str, limit: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` rows with the greatest key: a per-task top-n, then one merge."""
    return df.drop(*excluded).orderBy(F.desc(key)).limit(limit)


def important_columns(
    metadata: DataFrame, table_name: str, levels: tuple[int, ...], target: str | None = None, skip_dates: bool = True
) -> list[str]:
    """Column names of one table at the given importance levels, the target last."""
    rows = (
        metadata.where((F.col("table_name") == table_name) & F.col("importance_level").isin(list(levels)))
        .orderBy("feature_id")
        .select("column_name")
        .collect()  # one row per table column
    )
    names = [r.column_name for r in rows if not (skip_dates and "date" in r.column_name)]
    if not names:
        raise ValueError(f"no important columns recorded for {table_name}")
    if target:
        names = [n for n in names if n != target] + [target]
    return names


def project_important(
    df: DataFrame, metadata: DataFrame, table_name: str, levels: tuple[int, ...] = (4, 3), target: str | None = None
) -> DataFrame:
    return df.select(*important_columns(metadata, table_name, levels, target))
