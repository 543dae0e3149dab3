"""Category encoders. Maps are built from distinct values, never from raw rows."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loantriad.operators.ranks import global_index
from loantriad.session import small_side


def label_maps(df: DataFrame, columns: list[str], null_text: str | None = "None") -> DataFrame:
    """(column, value, code): codes 0.. in sorted order of the value. All columns share one sort."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    flat = df.select(F.inline(cells))
    flat = flat.where("value is not null") if null_text is None else flat.withColumn("value", F.coalesce("value", F.lit(null_text)))
    ranked = global_index(flat.distinct(), [F.col("column"), F.col("value")])
    first = ranked.groupBy("column").agg(F.min("rank").alias("_first"))  # one row per column
    return ranked.join(F.broadcast(first), "column").select("column", "value", (F.col("rank") - F.col("_first")).cast("int").alias("code"))


def encode_labels(df: DataFrame, columns: list[str], null_text: str | None = "None", suffix: str = "") -> DataFrame:
    """Replace (or, with ``suffix``, add) codes. Without ``null_text`` NULL stays NULL."""
    maps = label_maps(df, columns, null_text)
    out = df
    for c in columns:
        one = small_side(maps.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code")))
        text = F.col(c).cast("string")
        key = text if null_text is None else F.coalesce(text, F.lit(null_text))
        out = out.join(one, key == F.col("_v"), "left").withColumn(f"{c}{suffix}", F.col("_code")).drop("_v", "_code")
    return out.select(*df.columns, *[f"{c}{suffix}" for c in columns if suffix])


def factorize(df: DataFrame, column: str, row_id: str, out: str) -> DataFrame:
    """Codes 0.. in order of first appearance by ``row_id``; NULL is -1."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.min(row_id).alias("_at"))
    ranked = global_index(first, [F.col("_at"), F.col("_v")]).select("_v", (F.col("rank") - 1).cast("int").alias("_code"))
    joined = df.join(small_side(ranked), F.col(column) == F.col("_v"), "left")
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_code", F.lit(-1)).alias(out))


def categories(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """Sorted distinct values; refuses columns with more than ``limit``."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values: encode it with encode_labels instead")
    return sorted(r[0] for r in rows)


def dummy_columns(column: str, values: list[str], drop_first: bool = True) -> list[Column]:
    return [F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values[1 if drop_first else 0 :]]


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = True, limit: int = 1000) -> DataFrame:
    """0/1 columns in sorted category order, the first dropped; NULL is all zeros."""
    rest = [c for c in df.columns if c not in columns]
    made = [d for c in columns for d in dummy_columns(c, categories(df, c, limit), drop_first)]
    return df.select(*rest, *made)


def one_hot_vector(df: DataFrame, columns: list[str], numbers: list[str] = (), out: str = "features") -> DataFrame:
    """Vector of ``numbers`` and the 0/1 entries of ``one_hot``, without a column per value and without a limit of values.

    Entries follow the values of one column after the other, sorted as text, the first value dropped; NULL is all zeros.
    Rows hold only what is not zero. ``numbers`` must not be missing. No rows give vectors of the numbers alone.
    """
    codes = [f"_code_{i}" for i in range(len(columns))]
    hots = [f"_hot_{i}" for i in range(len(columns))]
    coded = encode_labels(df.withColumns(dict(zip(codes, map(F.col, columns)))), codes, None)
    sizes = coded.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in codes]).first() if codes else {}
    # the encoder drops the last place, so what has no entry (NULL and the first value) goes there
    placed = coded.withColumns({c: F.when(F.col(c) >= 1, F.col(c) - 1).otherwise(sizes[c]).cast("double") for c in codes})
    wide = [(c, h) for c, h in zip(codes, hots) if sizes[c] > 0]
    if wide:
        # fitted on one row per column, since the largest place is known
        most = df.sparkSession.createDataFrame([tuple(float(sizes[c]) for c, _ in wide)], ", ".join(f"{c} double" for c, _ in wide))
        placed = OneHotEncoder(inputCols=[c for c, _ in wide], outputCols=[h for _, h in wide]).fit(most).transform(placed)
    typed = placed.withColumns({f"_number_{i}": F.col(c).cast("double") for i, c in enumerate(numbers)})
    inputs = [*[f"_number_{i}" for i in range(len(numbers))], *[h for _, h in wide]]
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(typed).select(*df.columns, out)


@F.udf(T.ArrayType(T.IntegerType()))
def filled_places(vector):
    """Places of a vector that are not zero, ascending; a vector with a place per value is never unrolled."""
    return None if vector is None else [int(i) for i in vector.indices] if hasattr(vector, "indices") else [int(i) for i in vector.array.nonzero()[0]]
