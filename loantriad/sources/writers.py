"""Result tables and loan batches to storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def save_table_csv(df: DataFrame, root: str, folder: str, name: str) -> str:
    """CSV with header under ``root/folder/name`` (a directory of part files)."""
    path = f"{root.rstrip('/')}/{folder}/{name}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def append_batch(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, target: str, batch: int = 5000, **options: str) -> None:
    df.write.format("jdbc").mode("append").option("url", url).option("dbtable", target).option(
        "batchsize", batch
    ).options(**options).save()


def with_synthetic_flag(df: DataFrame, column: str = "is_synthetic") -> DataFrame:
    """The target layout: the same columns plus a flag, 0 by default."""
    return df if column in df.columns else df.withColumn(column, F.lit(0))


def replace_table(df: DataFrame, path: str) -> None:
    """Empty the target, then load."""
    df.write.mode("overwrite").parquet(path)


def replace_jdbc(df: DataFrame, url: str, target: str, batch: int = 5000, **options: str) -> None:
    df.write.format("jdbc").mode("overwrite").option("truncate", True).option("url", url).option(
        "dbtable", target
    ).option("batchsize", batch).options(**options).save()
