"""Randomness as a function of the row id, so a retried task draws the same values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_order(row_id: Column, seed: object = 42) -> Column:
    """Hex text whose order is the seeded shuffle of ``row_id``."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def hash_uniform(row_id: Column, seed: object = 42) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_order(row_id, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
