"""Exact ranks, prefix sums and order statistics without a single-task window.

Three tools, by what is asked:

* ``hash_cutoffs``: the k-th smallest shuffle hash per stratum. A split or fold then is a filter on
  the hash; the rows themselves are never sorted or shuffled.
* ``order_statistics``: the k-th smallest value of many columns at once. A sketch brackets each rank,
  one exact count checks the bracket, and only the values inside it are grouped and sorted.
* ``global_index`` / ``running_totals``: a rank or prefix sum for every row of a (pre-aggregated)
  table, from a range-partitioned sort plus per-partition offsets.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window, functions as F

from loantriad.functions.hashing import hash_order
from loantriad.session import materialise, settle, small_side


BUCKET_ROWS = 10_000


def _sorted_parts(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Sort globally and store; ``_part`` is the sort partition, ``_pos`` the place inside it.

    Stored because the partition number must be the same each time the table is read.
    """
    placed = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    stored = materialise(placed, name)
    return stored.select(
        *df.columns,
        F.shiftright("_mid", 33).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def _offsets(parts: DataFrame, totals: list[Column], names: list[str]) -> DataFrame:
    """Totals of all earlier sort partitions: one row per partition, a bounded table."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = parts.groupBy("_part").agg(*[t.alias(n) for t, n in zip(totals, names)])
    return per_part.select(
        "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in names]
    )


def global_index(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Add a 1-based rank in ``order`` (which must be a total order for a repeatable answer)."""
    parts = _sorted_parts(df, order, "index")
    offsets = F.broadcast(_offsets(parts, [F.count(F.lit(1))], ["n"]))
    return parts.join(offsets, "_part").select(
        *df.columns, (F.col("_off_n") + F.col("_pos") + 1).cast("bigint").alias(out)
    )


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add inclusive prefix sums ``{output: input}`` in ``order``.

    Pre-aggregate so that ``order`` is unique: then no sort partition can hold a hot value.
    """
    parts = _sorted_parts(df, order, "prefix")
    names = list(sums)
    offsets = F.broadcast(_offsets(parts, [F.sum(sums[n]) for n in names], names))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(offsets, "_part").select(
        *df.columns,
        *[(F.col(f"_off_{n}") + F.sum(sums[n]).over(inside)).alias(n) for n in names],
    )


def stratum_key(strata: list[str]) -> Column:
    """Strata as one struct, so NULL is a stratum like any other."""
    return F.struct(*strata) if strata else F.struct(F.lit(0).alias("all"))


def hash_cutoffs(
    df: DataFrame,
    row_id: str,
    targets: DataFrame,
    strata: list[str] | None = None,
    seed: object = 42,
    digits: int | None = None,
) -> DataFrame:
    """Hash of the row at each wanted rank: rows ``(_key, target, cutoff)``.

    ``targets`` has ``_key`` (see ``stratum_key``), ``target`` (any label) and ``rank`` (1-based). The
    leading ``digits`` hex digits split each stratum into even buckets, hot strata included; counts
    find the bucket of each rank and only those buckets are ranked. By default digits grow with the
    largest rank, so that a bucket holds some ten thousand rows at any table size.
    """
    if digits is None:
        top = targets.agg(F.max("rank")).first()[0] or 1
        digits = max(3, math.ceil(math.log(max(1.0, top / BUCKET_ROWS), 16)))
    narrow = settle(df.select(row_id, *(strata or [])))
    hashed = narrow.select(
        stratum_key(strata or []).alias("_key"), hash_order(F.col(row_id), seed).alias("_hash")
    ).withColumn("_bucket", F.substring("_hash", 1, digits))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hits = (
        counts.join(targets, "_key")
        .where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n")))
        .select("_key", "_bucket", "target", (F.col("rank") - F.col("_before")).alias("_want"))
    )
    hits = small_side(hits)
    wanted = hashed.join(hits.select("_key", "_bucket").distinct(), ["_key", "_bucket"], "left_semi")
    place = Window.partitionBy("_key", "_bucket").orderBy("_hash")
    ranked = wanted.withColumn("_want", F.row_number().over(place).cast("bigint"))
    return ranked.join(hits, ["_key", "_bucket", "_want"]).select("_key", "target", F.col("_hash").alias("cutoff"))


def rank_in_strata(
    df: DataFrame, row_id: str, strata: list[str], seed: object = 42, out: str = "rank", digits: int = 3
) -> DataFrame:
    """Rank of every row inside its stratum, in hash order.

    A hot stratum is spread over its hash buckets: sort inside (stratum, bucket), add bucket offsets.
    """
    keyed = df.withColumns({"_key": stratum_key(strata), "_hash": hash_order(F.col(row_id), seed)}).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_key", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    place = Window.partitionBy("_key", "_bucket").orderBy("_hash")
    return keyed.join(offsets, ["_key", "_bucket"]).select(
        *df.columns, (F.col("_off") + F.row_number().over(place)).cast("bigint").alias(out)
    )


def _bits(x: float) -> int:
    """Whole numbers in the order of doubles."""
    n = struct.unpack("<q", struct.pack("<d", x))[0]
    return n if n >= 0 else -(n & (1 << 63) - 1)


def _value(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n))[0] if n >= 0 else -struct.unpack("<d", struct.pack("<q", -n))[0]


def _halves(k: dict) -> list[tuple[float, float, list[int]]]:
    """The two halves of a bracket's doubles; every rank may lie in either."""
    middle = _value((_bits(k["lo"]) + _bits(k["hi"])) // 2)
    return [(k["lo"], middle, k["ranks"]), (math.nextafter(middle, math.inf), k["hi"], k["ranks"])]


def _sketched(df: DataFrame, wide: list[dict], accuracy: int) -> list[list[tuple[float, float, list[int]]]]:
    """Values around each rank from one sketch per bracket; overlapping ranges are merged."""
    room, sketches = 4.0 / accuracy, []
    for k in wide:
        spots = [(r - k["below"]) / (k["upto"] - k["below"]) for r in k["ranks"]]
        span = [q for at in spots for q in (max(0.0, at - room), min(1.0, at + room))]
        sketches.append(F.percentile_approx(F.when(k["x"].between(k["lo"], k["hi"]), k["x"]), span, accuracy))
    row = df.agg(*[q.alias(f"q{i}") for i, q in enumerate(sketches)]).first() if wide else []
    out = []
    for k, marks in zip(wide, row):
        found: list[tuple[float, float, list[int]]] = []
        for r, lo, hi in zip(k["ranks"], marks[::2], marks[1::2]):
            if found and lo <= found[-1][1]:
                found[-1] = found[-1][0], max(hi, found[-1][1]), [*found[-1][2], r]
            else:
                found.append((lo, hi, [r]))
        out.append(found)
    return out


def _narrow(df: DataFrame, wide: list[dict], accuracy: int) -> list[dict]:
    """Narrower brackets for the ranks of wide ones.

    A sketch says where a rank lies, one exact count checks it. The values at both ends of a range are cut out by exact
    counts, so a hot value becomes a bracket of its own. A bracket that the sketch missed, or that kept more than half of its
    rows, is next cut in half by value. So a round halves either the rows or the doubles of a bracket, and rounds end after
    64 and the logarithm of the rows at most.
    """
    parts = dict(zip((id(k) for k in wide if not k["halve"]), _sketched(df, [k for k in wide if not k["halve"]], accuracy)))
    tried = [(k, *part) for k in wide for part in (_halves(k) if k["halve"] else parts[id(k)])]
    row = df.agg(*[F.count(F.when(test, 1)).alias(f"c{i}_{j}") for i, (k, lo, hi, _) in enumerate(tried)
                   for j, test in enumerate((k["x"] < lo, k["x"] <= lo, k["x"] < hi, k["x"] <= hi))]).first()
    out: list[dict] = []
    found: dict[int, set[int]] = {id(k): set() for k in wide}
    for i, (k, lo, hi, ranks) in enumerate(tried):
        below, with_lo, before_hi, upto = row[4 * i:4 * i + 4]
        inner_lo, inner_hi = math.nextafter(lo, math.inf), math.nextafter(hi, -math.inf)
        for low, high, rows_before, rows_upto in ((lo, lo, below, with_lo), (inner_lo, inner_hi, with_lo, before_hi), (hi, hi, max(before_hi, with_lo), upto)):
            inside = [r for r in ranks if rows_before < r <= rows_upto and r not in found[id(k)]]
            if inside:
                found[id(k)].update(inside)
                out.append({"column": k["column"], "x": k["x"], "lo": low, "hi": high, "below": rows_before, "upto": rows_upto,
                            "ranks": inside, "halve": 2 * (rows_upto - rows_before) > k["upto"] - k["below"]})
    for k in wide:
        missed = [r for r in k["ranks"] if r not in found[id(k)]]
        if missed:
            out.append({**k, "ranks": missed, "halve": True})
    return out


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], accuracy: int = 2000, most: int = 200_000, sizes: dict[str, int] | None = None
) -> dict[str, dict[int, float]]:
    """Exact value at each 1-based rank of each numeric column (NULL and NaN ignored).

    Brackets are narrowed (see ``_narrow``) until at most ``most`` rows or one value are left, so the sorted rest stays
    small at any table size. Driver work: a few numbers per rank.
    """
    wanted = {c: sorted(set(rs)) for c, rs in ranks.items() if rs}
    if not wanted:
        return {}
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in wanted}
    if sizes is None:
        row = df.agg(*[F.count(x[c]).alias(c) for c in wanted]).first()
        sizes = {c: row[c] for c in wanted}
    for c, rs in wanted.items():
        if rs[0] < 1 or rs[-1] > sizes[c]:
            raise ValueError(f"ranks {rs[0]}..{rs[-1]} outside 1..{sizes[c]} of {c}")
    brackets = [
        {"column": c, "x": x[c], "lo": -math.inf, "hi": math.inf, "below": 0, "upto": sizes[c], "ranks": rs, "halve": False}
        for c, rs in wanted.items()
    ]
    while True:
        wide = [k for k in brackets if k["lo"] < k["hi"] and k["upto"] - k["below"] > most]
        if not wide:
            break
        brackets = [k for k in brackets if not any(k is w for w in wide)] + _narrow(df, wide, accuracy)

    inside = F.array(
        *[F.when(k["x"].between(k["lo"], k["hi"]), F.struct(F.lit(i).alias("i"), k["x"].alias("x"))) for i, k in enumerate(brackets)]
    )
    flat = df.select(F.explode(F.array_compact(inside)).alias("e")).select("e.i", "e.x")
    grouped = flat.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.element_at(
        F.array(*[F.array(*[F.lit(r - k["below"]).cast("bigint") for r in k["ranks"]]) for k in brackets]), F.col("i") + 1
    )
    found = (
        grouped.withColumn("c", F.sum("n").over(upto))
        .select("i", "x", F.explode(F.filter(asked, lambda w: (w <= F.col("c")) & (w > F.col("c") - F.col("n")))).alias("w"))
        .collect()
    )
    out: dict[str, dict[int, float]] = {c: {} for c in ranks}
    for row in found:
        k = brackets[row.i]
        out[k["column"]][row.w + k["below"]] = row.x
    return out


def percentiles(
    df: DataFrame, columns: list[str], probs: list[float], method: str = "linear", accuracy: int = 2000
) -> dict[str, dict[float, float | None]]:
    """Exact interpolated percentiles of several columns.

    ``linear`` places p at p * (n - 1); ``legacy`` at p * (n + 1) clamped to the extremes.
    """
    df = settle(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]))
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    plan: dict[str, dict[float, tuple[int, int, float]]] = {}
    for c in columns:
        n = sizes[c]
        if n == 0:
            continue
        plan[c] = {}
        for p in probs:
            spot = 1 + p * (n - 1) if method == "linear" else min(max(p * (n + 1), 1.0), float(n))
            low = min(int(math.floor(spot)), n)
            plan[c][p] = (low, min(low + 1, n), spot - low)
    needed = {c: [r for lo, hi, _ in marks.values() for r in (lo, hi)] for c, marks in plan.items()}
    stats = order_statistics(df, needed, accuracy, sizes={c: sizes[c] for c in needed})
    out: dict[str, dict[float, float | None]] = {}
    for c in columns:
        out[c] = {p: None for p in probs}
        for p, (lo, hi, part) in plan.get(c, {}).items():
            a, b = stats[c][lo], stats[c][hi]
            out[c][p] = a + part * (b - a)
    return out
