"""Pairwise correlation and the filter built on it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def pair_list(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pair_sums(width: int, centre: np.ndarray):
    """Function for mapInArrow: sums of one task for every pair i < j over rows where both are present."""
    left, right = np.triu_indices(width, 1)

    def run(batches):
        totals, seen = np.zeros((len(SUMS), width, width)), False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            raw = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(width)])
            here = (~np.isnan(raw)).astype("float64")
            x = np.where(here == 1, raw - centre, 0.0)
            squares = x * x
            totals += np.stack([here.T @ here, x.T @ here, here.T @ x, squares.T @ here, here.T @ squares, x.T @ x])
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int32()), pa.array(right, pa.int32())] + [pa.array(t[left, right], pa.float64()) for t in totals],
                names=["i", "j", *SUMS],
            )

    return run


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every column pair over the rows where both are present; NULL for a constant column.

    One scan whatever the number of columns: a task multiplies its own batches and emits one row of sums
    per pair. Values are centred first, so the sums lose nothing.
    """
    spark = df.sparkSession
    x = {c: F.col(c).cast("double") for c in columns}
    shape = df.agg(*[F.struct(F.avg(x[c]).alias("m"), (F.max(x[c]) - F.min(x[c])).alias("r")).alias(c) for c in columns]).first()
    centre = np.array([shape[c].m or 0.0 for c in columns])
    names = spark.createDataFrame(
        [(i, j, a, b, float(shape[a].r or 0.0), float(shape[b].r or 0.0)) for (i, a), (j, b) in combinations(enumerate(columns), 2)],
        "i int, j int, col1 string, col2 string, r1 double, r2 double",
    )
    schema = "i int, j int, " + ", ".join(f"{n} double" for n in SUMS)
    sums = df.select(*x.values()).mapInArrow(_pair_sums(len(columns), centre), schema)
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in SUMS)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    floor = 1e-18 * n * n  # relative to the range: below it a variance is rounding noise
    steady = (n < 2) | (vx <= floor * F.col("r1") * F.col("r1")) | (vy <= floor * F.col("r2") * F.col("r2"))
    r = F.when(~steady, (n * sxy - sx * sy) / F.sqrt(vx * vy))
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS]).join(names, ["i", "j"]).select("col1", "col2", r.alias("pearson"))


def correlation_matrix(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Symmetric matrix with a unit diagonal, one row per column."""
    half = pearson_pairs(df, columns)
    cells = half.select(
        F.inline(
            F.array(
                F.struct(F.col("col1").alias("column"), F.col("col2").alias("other"), "pearson"),
                F.struct(F.col("col2").alias("column"), F.col("col1").alias("other"), "pearson"),
            )
        )
    )
    wide = cells.groupBy("column").pivot("other", columns).agg(F.first("pearson"))
    return wide.select("column", *[F.when(F.col("column") == c, 1.0).otherwise(F.round(c, digits)).alias(c) for c in columns])


def correlated_columns(
    df: DataFrame, columns: list[str], threshold: float, target: str | None = None, protected: tuple[str, ...] = ()
) -> list[str]:
    """Later column of each pair above the threshold; a column already marked still marks others."""
    tested = [c for c in columns if c != target and c not in protected]
    if len(tested) < 2:
        return []
    high = pearson_pairs(df, tested).where(F.abs("pearson") > threshold).collect()  # bounded by column pairs
    marked = {row.col2 for row in high}
    return [c for c in tested if c in marked]


def drop_correlated(
    df: DataFrame, columns: list[str], threshold: float = 0.7, target: str | None = None, protected: tuple[str, ...] = ()
) -> DataFrame:
    return df.drop(*correlated_columns(df, columns, threshold, target, protected))
