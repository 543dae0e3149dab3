"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest capacity are cut: full pieces are bins of their own, the rest is packed. Rests are
dealt by row into groups of about ``GROUP_ROWS``; each group is packed alone, largest first, into the open bin with the
least room that suffices. If none does, a bin is opened whose size has the least cost per token it can expect to hold:
the piece and the smaller pieces still to come that fit beside it. At last each bin shrinks to the smallest permitted
size that holds its contents. A sequence of length c costs c * (1 + c / ``ATTENTION``).

Groups are many, equal and independent, so work grows in proportion and a lost task repeats the same packing.

Defined results: every token of every row lies in exactly one bin; a row of null or 0 tokens is one piece of length 0;
repeated rows are packed each; an empty table gives an empty table. Only doc_id and n_tokens are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.llm.bpe import file_text
from loantriad.llm.common import beside, table, vocabulary_path
from loantriad.llm.registry import corpus_query
from loantriad.llm.whole_ids import WholeTexts
from loantriad.session import materialise

CAPACITIES = (512, 1024, 2048, 4096, 8192)
ATTENTION = 32_768
GROUP_ROWS = 16_384


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION)


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Bin, slot and offset in the bin of each piece, and the final capacity of each bin. Pieces fit the largest size."""
    sizes = np.asarray(lengths, np.int64)
    capacities = sorted(capacities)
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    to_come = np.concatenate([np.cumsum(falling[::-1])[::-1], [0]])  # tokens from a place on
    bins = np.zeros(len(sizes), np.int64)
    slots = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (tokens free, bin), sorted
    opened: list[int] = []
    used: list[int] = []
    held: list[int] = []
    for place, item in enumerate(order.tolist()):
        size = int(sizes[item])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            best = None
            for c in capacities:
                if c < size:
                    continue
                beside = max(place + 1, int(np.searchsorted(-falling, size - c)))
                fill = min(c, size + int(to_come[beside]))
                price = cost(c) / max(fill, 1)
                if best is None or price < best[0]:
                    best = (price, c)
            b, free = len(opened), best[1]
            opened.append(free)
            used.append(0)
            held.append(0)
        bins[item], slots[item], offsets[item] = b, held[b], used[b]
        used[b] += size
        held[b] += 1
        insort(room, (free - size, b))
    final = [next(c for c in capacities if c >= u) for u in used]
    return bins, slots, offsets, final


PACKED = "doc_id long, piece int, start long, length long, bin string, slot int, bin_offset long, capacity int"


def best_fit(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """PACKED rows: which tokens of a document (start, length) lie where in which bin. ``lengths``: doc_id, n_tokens."""
    most = max(capacities)
    stored = materialise(lengths.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")), "lengths")
    rows = stored.withColumn("row", F.monotonically_increasing_id())
    full = F.floor(F.col("n_tokens") / most).cast("int")
    whole = rows.where(F.col("n_tokens") >= most).select(
        "doc_id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece")
    ).select(
        "doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.lit(most).cast("long").alias("length"),
        F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("bin_offset"),
        F.lit(most).alias("capacity"))
    rests = rows.select("doc_id", "row", full.alias("piece"), (full.cast("long") * most).alias("start"),
                        (F.col("n_tokens") % most).alias("length")).where("length > 0 or piece = 0")
    groups = max(1, -(-stored.count() // group_rows))
    dealt = rests.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:  # Arrow: ids beside a null stay whole
        group = group.sort_by("row")
        bins, slots, offsets, final = pack(group["length"].to_numpy(), capacities)
        number = group["group"][0].as_py()
        return pa.table({
            **{c: group[c] for c in ("doc_id", "piece", "start", "length")}, "bin": [f"{number}-{b}" for b in bins],
            "slot": pa.array(slots, pa.int32()), "bin_offset": pa.array(offsets, pa.int64()),
            "capacity": pa.array([final[b] for b in bins], pa.int32())})

    return whole.unionByName(dealt.groupBy("group").applyInArrow(run, PACKED))


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and number of ids, the end id included, of every row."""
    content = docs.sparkSession.sparkContext.broadcast(file_text(path))

    def start():
        whole = WholeTexts(content.value)

        def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"n_tokens": [len(whole.ids([text])[0]) + 1 if text else 1 for text in frame["text"]]})

        return run

    return beside(docs, ["doc_id"], ["text"], start, "n_tokens long")


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Packs documents by their merged ids and one end id, as the token files hold them."""
    return best_fit(token_lengths(docs, path or vocabulary_path("byte_bpe_50k.json")))


@corpus_query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
