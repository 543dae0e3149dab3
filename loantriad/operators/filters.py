"""Row filters and column choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loantriad.session import small_side


def column_where(df: DataFrame, column: str, condition: str) -> DataFrame:
    """One column as double under a SQL predicate, NULLs removed."""
    return df.where(F.expr(condition)).select(F.col(column).cast("double").alias(column)).dropna()


def two_columns(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.select(first, second).dropna("any")


def complete_rows(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Key and fields of the rows where every field is present."""
    if not fields:
        raise ValueError("at least one field is needed")
    return df.select(key, *fields).dropna("any", subset=fields)


def equal_to(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def in_range(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def active(flag: str = "is_deleted", key: str = "len_id", below: int = 100) -> Column:
    """Rows not deleted; the key bound belongs to the NULL branch only."""
    return (F.col(flag) != 1) | (F.col(flag).isNull() & (F.col(key) < below))


def non_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are numbers >= 0; text that is no number counts as missing."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.col(c).try_cast("double") >= 0)
    return df.where(keep)


def distinct_values(df: DataFrame, column: str, condition: str | None = None) -> DataFrame:
    return (df.where(F.expr(condition)) if condition else df).select(column).distinct()


def soft_delete(df: DataFrame, keys: DataFrame, key: str, flag: str = "is_deleted") -> DataFrame:
    """New table with ``flag`` 1 for the listed keys, unchanged (or NULL) elsewhere."""
    old = F.col(flag) if flag in df.columns else F.lit(None).cast("int")
    marks = small_side(keys.select(key).distinct()).withColumn("_hit", F.lit(1))
    return df.join(marks, key, "left").withColumn(flag, F.coalesce("_hit", old)).drop("_hit")


def keep_features(df: DataFrame, chosen: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    wanted = set(chosen) | set(protected)
    return df.select(*[c for c in df.columns if c in wanted])
