"""Splits, folds, stratified samples, bags. All draws are functions of the row id."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from loantriad.functions.hashing import hash_order, hash_uniform
from loantriad.operators.ranks import hash_cutoffs, rank_in_strata, stratum_key
from loantriad.session import small_side


def _cut_at(df: DataFrame, row_id: str, ranks: list[int], seed: object) -> list[str]:
    """Hashes at the given ranks of the whole table; rank 0 gives a text below every hash."""
    spark = df.sparkSession
    targets = spark.createDataFrame(
        [(i, r) for i, r in enumerate(ranks) if r > 0], "target int, rank bigint"
    ).withColumn("_key", stratum_key([]))
    found = {r.target: r.cutoff for r in hash_cutoffs(df, row_id, targets, seed=seed).collect()}
    return [found.get(i, "") for i in range(len(ranks))]


def split_first(df: DataFrame, row_id: str, rows: int, seed: object = 42) -> tuple[DataFrame, DataFrame]:
    """The first ``rows`` rows of the seeded shuffle, and the rest. Both are filters on ``df``."""
    cutoff = _cut_at(df, row_id, [rows], seed)[0]
    inside = hash_order(F.col(row_id), seed) <= cutoff
    return df.where(inside), df.where(~inside)


def train_test_split(df: DataFrame, row_id: str, test_share: float = 0.2, seed: object = 42) -> tuple[DataFrame, DataFrame]:
    """Exact sizes: the test part is rounded up."""
    n = df.count()
    return split_first(df, row_id, n - math.ceil(test_share * n), seed)


def ratio_split(df: DataFrame, row_id: str, train_ratio: float = 0.7, seed: object = 42) -> tuple[DataFrame, DataFrame]:
    """Exact sizes: the training part is rounded to the nearest, halves up."""
    return split_first(df, row_id, math.floor(df.count() * train_ratio + 0.5), seed)


def fold_ends(n: int, k: int) -> list[int]:
    """Last rank of each fold but the final one; sizes differ by at most one, larger folds first."""
    small, extra = divmod(n, k)
    return [j * small + min(j, extra) for j in range(1, k)]


def k_fold(df: DataFrame, row_id: str, k: int = 5, seed: object = 42, out: str = "fold") -> DataFrame:
    """Add a 0-based fold: consecutive slices of the seeded shuffle."""
    cuts = _cut_at(df, row_id, fold_ends(df.count(), k), seed)
    hashed = hash_order(F.col(row_id), seed)
    fold = sum(((hashed > c).cast("int") for c in cuts), F.lit(0))
    return df.withColumn(out, fold)


def stratified_k_fold(
    df: DataFrame, row_id: str, strata: list[str], k: int = 5, seed: object = 42, out: str = "fold"
) -> DataFrame:
    """Add a 0-based fold that keeps the share of each stratum. Rows are not shuffled or sorted."""
    key = stratum_key(strata)
    n = F.col("n")
    small, extra = F.floor(n / k), n % k
    ends = F.array(*[F.struct(F.lit(j).alias("target"), (j * small + F.least(F.lit(j), extra)).cast("bigint").alias("rank")) for j in range(1, k)])
    targets = df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n")).select("_key", F.inline(ends))
    cut = hash_cutoffs(df, row_id, targets.where("rank > 0"), strata, seed)
    filled = targets.join(cut, ["_key", "target"], "left").select("_key", F.coalesce("cutoff", F.lit("")).alias("cutoff"))
    table = small_side(filled.groupBy("_key").agg(F.collect_list("cutoff").alias("_cuts")))  # k - 1 per stratum
    hashed = hash_order(F.col(row_id), seed)
    joined = df.withColumn("_key", key).join(table, "_key")
    fold = sum(((hashed > F.get("_cuts", F.lit(j))).cast("int") for j in range(k - 1)), F.lit(0))
    return joined.select(*df.columns, fold.alias(out))


def proportional_quotas(counts: DataFrame, rows: int, n: str = "n") -> DataFrame:
    """Add ``quota``: rows * share rounded half to even, the rounding rest to the largest stratum.

    ``counts`` has one row per stratum.
    """
    everything = Window.partitionBy(F.lit(0))
    first = Window.partitionBy(F.lit(0)).orderBy(F.desc(n), *[c for c in counts.columns if c != n])
    rounded = counts.withColumn("quota", F.bround(rows * (F.col(n) / F.sum(n).over(everything)), 0).cast("bigint"))
    rest = F.lit(rows) - F.sum("quota").over(everything)
    return (
        rounded.withColumns({"_rest": rest, "_first": F.row_number().over(first)})
        .withColumn("quota", F.col("quota") + F.when(F.col("_first") == 1, F.col("_rest")).otherwise(0))
        .drop("_rest", "_first")
    )


def proportional_sample(df: DataFrame, row_id: str, stratum: str, rows: int, seed: object = 42) -> DataFrame:
    """Random rows of each stratum up to its quota. Rows without a stratum count toward the shares only."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    quotas = proportional_quotas(counts, rows).where(F.col(stratum).isNotNull())
    targets = quotas.select(
        stratum_key([stratum]).alias("_key"), F.lit(0).alias("target"), F.least("quota", "n").alias("rank")
    ).where("rank > 0")
    cut = small_side(hash_cutoffs(df, row_id, targets, [stratum], seed).select("_key", "cutoff"))
    joined = df.withColumn("_key", stratum_key([stratum])).join(cut, "_key")
    return joined.where(hash_order(F.col(row_id), seed) <= F.col("cutoff")).select(*df.columns)


def is_marked(position: Column, n: Column, share: float) -> Column:
    """Whether a 0-based position is one of the evenly spaced marks of a stratum of ``n`` rows.

    Mark i sits at round(i * step + step / 2), half to even, at most n - 1. Only the marks next to the
    position can hit it, so the test is plain arithmetic.
    """
    marks = F.ceil(n * share)
    step = n / marks
    near = F.floor((position - step / 2) / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1, 2):
        i = near + shift
        spot = F.least(F.bround(i * step + step / 2, 0).cast("bigint"), n - 1)
        hit = hit | ((i >= 0) & (i < marks) & (spot == position))
    return hit


def systematic_marks(
    df: DataFrame,
    row_id: str,
    stratum: str,
    share: float = 0.1,
    seed: object = 42,
    flag: str = "is_synthetic",
    replace: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Flag evenly spaced rows of each stratum and give them uniform values in the ``replace`` ranges."""
    sizes = df.groupBy(stratum_key([stratum]).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_in_strata(df, row_id, [stratum], seed, "_rank").withColumn("_key", stratum_key([stratum]))
    marked = ranked.join(small_side(sizes), "_key").withColumn(flag, is_marked(F.col("_rank") - 1, F.col("_n"), share).cast("int"))
    for column, (low, high) in (replace or {}).items():
        draw = low + (high - low) * hash_uniform(F.col(row_id), f"{seed}:{column}")
        marked = marked.withColumn(column, F.when(F.col(flag) == 1, draw).otherwise(F.col(column)))
    return marked.select(*df.columns, flag)


def poisson_limits(rate: float, tail: float = 1e-12) -> list[float]:
    """Cumulative Poisson probabilities until the tail is negligible."""
    limits, term, total, i = [], math.exp(-rate), 0.0, 0
    while total < 1 - tail and (term > 0 or i < rate):
        total += term
        limits.append(total)
        i += 1
        term *= rate / i
    return limits


def bag_draw(row_id: Column, bag: int, seed: object = 42) -> Column:
    """The uniform draw that decides how often a row enters a bag."""
    return hash_uniform(row_id, f"{seed}:bag{bag}")


def poisson_count(draw: Column, share: float) -> Column:
    """Poisson(share) count of a uniform draw, the large-table form of drawing with replacement."""
    return sum(((draw >= limit).cast("int") for limit in poisson_limits(share)), F.lit(0))


def in_bag(row_id: Column, bag: int, share: float = 1.0, seed: object = 42) -> Column:
    """Whether a row enters a bag at all: one comparison."""
    return bag_draw(row_id, bag, seed) >= math.exp(-share)


def bootstrap(df: DataFrame, row_id: str, bag: int, share: float = 0.8, seed: object = 42) -> DataFrame:
    """Rows of one bag with their ``copies`` (use it as a weight; rows with none are out of the bag).

    The draw is hashed once per row: it is a column of its own before the counts are read off it.
    """
    inside = df.where(in_bag(F.col(row_id), bag, share, seed)).withColumn("_draw", bag_draw(F.col(row_id), bag, seed))
    return inside.withColumn("copies", poisson_count(F.col("_draw"), share)).drop("_draw")


def bootstrap_features(columns: list[str], bag: int, share: float = 0.8, seed: int = 42) -> list[str]:
    """Columns drawn with replacement; repeats add nothing to a tree, so each is listed once."""
    rng = random.Random(f"{seed}:{bag}")
    drawn = {rng.choice(columns) for _ in range(max(1, int(share * len(columns))))}
    return [c for c in columns if c in drawn]
