"""Dates as numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_ORIGIN = "2000-01-01"


def days_since_origin(day: Column, origin: str = DAY_ORIGIN) -> Column:
    return F.datediff(day.cast("date"), F.lit(origin).cast("date"))


def epoch_seconds(moment: Column) -> Column:
    """Whole seconds since 1970-01-01, read without any time-zone shift."""
    return F.floor(F.unix_micros(moment.cast("timestamp_ntz").cast("timestamp")) / 1_000_000).cast("bigint")
