"""From raw documents to packed training sequences, one operator a stage.

Quality rules, toxicity, near duplicates (five words, similarity 0.8; one document of each group stays), repeated
passages, best-fit packing. Every stage works on all rows that its predecessor kept; all but the last return the columns
of ``documents``. Every row is decided by itself, whatever its doc_id: operators are given row numbers as ids, and
rejections take effect by a join on those, so columns with any names pass through. Of near duplicates the row with the
least doc_id stays (rows without doc_id last, one of equal rows); rows without words are no duplicates.
Empty tables pass through as such.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from loantriad.llm import neardup, packing, passages, quality, toxicity  # noqa: E402
from loantriad.llm.common import table  # noqa: E402
from loantriad.session import materialise, settle, ship_package  # noqa: E402

#: Language-model scoring and trained labels have no equivalent in SQL; tests compare each stage with brute force.
ORACLE_SQL = None

NEAR_PERCENT = 80


ROW = "_pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for every row, the same in each pass."""
    return settle(docs, "numbered").withColumn(ROW, F.monotonically_increasing_id())


def _texts(rows: DataFrame) -> DataFrame:
    """Row numbers, as doc_id, and texts."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """``rows`` without those whose numbers are ``rejected``'s doc_id."""
    gone = rejected.select(F.col("doc_id").alias(ROW))
    return rows.join(gone.hint("merge"), ROW, "left_anti").drop(ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    ratios = quality.log_ratios(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return _without(rows, quality.score(_texts(rows), ratios).where("not kept"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    model = toxicity.fit(toxicity.train_rows(docs, table(spark, sf_dir, "labels")))
    return _without(rows, toxicity.score(_texts(rows), model).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = neardup.near_duplicates(_texts(rows), percent=NEAR_PERCENT).select(F.col("doc_id").alias(ROW), "component_id")
    ids = rows.select(ROW, F.col("doc_id").alias("id"))
    members = found.join(ids.hint("merge"), ROW)
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", ROW)).alias("least")).select(f"least.{ROW}")
    return rows.join(kept.hint("merge"), ROW, "left_semi").drop(ROW)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.remove_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


def _stage(fn):
    """``fn`` with the package on the executors."""
    return lambda spark, docs, sf_dir: fn(ship_package(spark), docs, sf_dir)


STAGES = [
    ("quality_rules", _stage(quality_rules)),
    ("toxicity", _stage(toxic_documents)),
    ("near_duplicates", _stage(near_duplicates)),
    ("repeated_passages", _stage(repeated_passages)),
    ("best_fit_packing", _stage(best_fit_packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
