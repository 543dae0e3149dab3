"""Cell parsing: blank or bad text becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INT_RANGE = (-2147483648.0, 2147483647.0)
BLANKS = "".join(chr(i) for i in range(33))  # everything up to the space, tabs and line breaks too


def cut(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def blank_to_null(cell: Column) -> Column:
    text = cut(cell)
    return F.when(text != "", text)


def parse_int(cell: Column, lenient: bool = False) -> Column:
    """Strict integer, or with ``lenient`` a decimal text truncated toward zero."""
    text = cut(cell)
    strict = text.try_cast("int")
    if not lenient:
        return strict
    number = text.try_cast("double")
    inside = F.when(F.isnan(number), 0.0).otherwise(F.greatest(F.lit(INT_RANGE[0]), F.least(F.lit(INT_RANGE[1]), number)))
    return F.coalesce(strict, F.when(number.isNotNull(), inside).cast("int"))


def parse_long(cell: Column) -> Column:
    return cut(cell).try_cast("bigint")


def parse_decimal(cell: Column, precision: int = 38, scale: int = 2) -> Column:
    return cut(cell).try_cast(f"decimal({precision},{scale})")


def parse_float(cell: Column) -> Column:
    return cut(cell).try_cast("float")


def parse_month_year(cell: Column) -> Column:
    """``Dec-2015`` becomes the first day of that month."""
    return F.try_to_timestamp(cut(cell), F.lit("MMM-yyyy")).cast("date")


def parse_date(cell: Column) -> Column:
    return F.try_to_timestamp(cut(cell), F.lit("yyyy-MM-dd")).cast("date")


def parse_timestamp(cell: Column) -> Column:
    return F.try_to_timestamp(cut(cell), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def parse_char(cell: Column) -> Column:
    return F.substring(blank_to_null(cell), 1, 1)


def parse_flag(cell: Column) -> Column:
    return cut(cell).try_cast("boolean")


def clean_quotes(cell: Column) -> Column:
    return cut(F.replace(cell, F.lit('"'), F.lit("")))
