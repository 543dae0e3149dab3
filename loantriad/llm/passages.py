"""Exact substring dedup: windows of words that occur elsewhere, found by super-k-mer partitioning.

Each window of ``width`` words has a minimiser, the least hash among its runs of ``run`` words. Neighbouring windows with
the same minimiser form a super-k-mer. Equal windows have equal minimisers, so only super-k-mers whose minimiser occurs
again (or that repeat a window inside) can hold repeats. Minimisers are counted first, as numbers; then the super-k-mers
in question travel to their minimiser's bucket, each as one packed string of its words. Equal strings are counted
before they are shuffled; a bucket sorts its windows and counts runs of equal ones, comparing the words themselves. A
minimiser with more than ``hot`` super-k-mers, or ``LONG`` times as many windows in them (a periodic text is one of all its
windows), gets a bucket per window, so that no bucket grows with the corpus or with a text.

Repeats are judged on the input: all copies go, the first one too. Rows are known by row numbers, so equal rows
are copies of each other and get equal results, whatever their ids.

Defined results: null or empty text, and texts shorter than a window, keep all their words; a null doc_id is a document
as any other; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.llm.common import WordHashes, beside, row_by_row, table, window_hashes, words_of
from loantriad.llm.registry import corpus_query
from loantriad.session import drop, materialise, settle

WIDTH = 35
RUN = 10
HOT = 1_000
LONG = 64
ROW = "_passage_row"
SPANS = "array<struct<a:int,b:int>>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def super_kmers(h: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, minimiser, and whether a window inside occurs twice in the text, of each super-k-mer."""
    least = sliding_min(window_hashes(h, run), width - run + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    _, inverse, counts = np.unique(window_hashes(h, width), return_inverse=True, return_counts=True)
    again = np.logical_or.reduceat(counts[inverse] > 1, starts)
    return starts, least[starts], again


def _minimisers(width: int, run: int):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            out = {c: [] for c in (ROW, "starts", "sizes", "minis", "again")}
            for number, text in zip(frame[ROW], frame["text"]):
                words = words_of(text)
                n = len(words) - width + 1
                if n <= 0:
                    continue
                starts, minis, again = super_kmers(hashes.of(words), width, run)
                row = (number, starts.astype(np.int32), np.diff(starts, append=n).astype(np.int32), minis.view(np.int64), again)
                for column, value in zip(out.values(), row):
                    column.append(value)
            if out[ROW]:
                yield pd.DataFrame(out)

    return go


def _pack(width: int):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for number, text, found in zip(frame[ROW], frame["text"], frame["found"]):
                words = words_of(text)
                for f in found:
                    start, size, mini = f["start"], f["size"], f["mini"]
                    if not f["split"]:
                        packed = b" ".join(words[start:start + size + width - 1])
                        out.append((number, start, mini, b"", name(packed), packed))
                        continue
                    for at in range(start, start + size):
                        window = b" ".join(words[at:at + width])
                        out.append((number, at, mini, name(window), name(window), window))
                        if len(out) >= 20_000:
                            yield _frame(out)
                            out = []
                if len(out) >= 20_000:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[ROW, "start", "mini", "sub", "name", "packed"]).astype(
            {ROW: "int64", "start": "int32", "mini": "int64"})

    return go


def name(packed: bytes) -> bytes:
    """128-bit name under which the places of a string find its result again."""
    return hashlib.blake2b(packed, digest_size=16).digest()


def repeated_spans(strings: list[bytes], counts: list[int], width: int) -> list[list[tuple[int, int]]]:
    """For each packed string of a bucket, the spans of its words under windows that occur twice or more in the bucket."""
    windows = []
    for k, packed in enumerate(strings):
        words = packed.split(b" ")
        windows += [(words[i:i + width], k, i) for i in range(len(words) - width + 1)]
    windows.sort()
    spans: list[list[tuple[int, int]]] = [[] for _ in strings]
    a = 0
    while a < len(windows):
        b = a
        total = 0
        while b < len(windows) and windows[b][0] == windows[a][0]:
            total += counts[windows[b][1]]
            b += 1
        if total > 1:
            for _, k, i in windows[a:b]:
                spans[k].append((i, i + width))
        a = b
    return [_merge(sorted(s)) for s in spans]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _count_buckets(width: int):
    """Rows come sorted by bucket; a bucket may go on in the next batch."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, strings, counts, out = None, [], [], []

        def close() -> None:
            if len(strings) > 1 or counts and (counts[0] > 1 or strings[0].count(b" ") >= width):
                for packed, spans in zip(strings, repeated_spans(strings, counts, width)):
                    if spans:
                        out.append((name(packed), [{"a": a, "b": b} for a, b in spans]))

        for frame in frames:
            for mini, sub, packed, n in zip(frame["mini"], frame["sub"], frame["packed"], frame["n"]):
                if key != (mini, sub):
                    if key is not None:
                        close()
                    key, strings, counts = (mini, sub), [], []
                strings.append(packed)
                counts.append(n)
            if out:
                yield pd.DataFrame(out, columns=["name", "spans"])
            out.clear()
        if key is not None:
            close()
        if out:
            yield pd.DataFrame(out, columns=["name", "spans"])

    return go


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for every row, the same in each pass."""
    return settle(docs, "numbered").withColumn(ROW, F.monotonically_increasing_id())


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans come sorted by row and start; overlapping ones become one as they pass, one result a row."""
    number, spans = None, []
    for frame in frames:
        out = []
        for row, a, b in zip(frame[ROW].tolist(), frame["a"].tolist(), frame["b"].tolist()):
            if row != number:
                if spans:
                    out.append((number, [{"a": x, "b": y} for x, y in spans]))
                number, spans = row, []
            if spans and a <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(b, spans[-1][1])
            else:
                spans.append((a, b))
        yield pd.DataFrame(out, columns=[ROW, "spans"])
    if spans:
        yield pd.DataFrame([(number, [{"a": x, "b": y} for x, y in spans])], columns=[ROW, "spans"])


def find_repeats(rows: DataFrame, width: int = WIDTH, run: int = RUN, hot: int = HOT) -> DataFrame:
    """ROW and the spans of words [a, b) under repeated windows (merged, ascending) of every text that has some.

    ``rows``: ROW and text, as ``numbered`` gives them. Joins are sort-merge joins at every size, so disk grows with the input.
    """
    rows = rows.select(ROW, "text")
    kmers = materialise(rows.mapInPandas(
        _minimisers(width, run), f"{ROW} long, starts array<int>, sizes array<int>, minis array<long>, again array<boolean>"), "super-kmers", free=True)
    each = kmers.select(ROW, F.explode(F.arrays_zip("starts", "sizes", "minis", "again")).alias("z")).select(
        ROW, F.col("z.starts").alias("start"), F.col("z.sizes").alias("size"), F.col("z.minis").alias("mini"),
        F.col("z.again").alias("again"))
    counts = each.groupBy("mini").agg(F.count("*").alias("n"), F.sum("size").alias("windows"), F.max("again").alias("again"))
    split = (F.col("n") > hot) | (F.col("windows") > LONG * hot)
    again = materialise(counts.where("n > 1 or again").select("mini", split.alias("split")), "repeated-minimisers", free=True)
    found = each.join(again.hint("merge"), "mini").groupBy(ROW).agg(F.collect_list(F.struct("start", "size", "mini", "split")).alias("found"))
    packed = materialise(rows.join(found.hint("merge"), ROW).mapInPandas(
        _pack(width), f"{ROW} long, start int, mini long, sub binary, name binary, packed binary"), "packed", free=True)
    drop(kmers, again)
    strings = packed.groupBy("mini", "sub", "packed").agg(F.count("*").alias("n"))
    buckets = strings.repartition("mini", "sub").sortWithinPartitions("mini", "sub")
    repeats = materialise(buckets.mapInPandas(_count_buckets(width), f"name binary, spans {SPANS}"), "repeats", free=True)
    spans = packed.select(ROW, "start", "name").join(repeats.hint("merge"), "name").select(ROW, "start", F.explode("spans").alias("s"))
    spans = spans.groupBy(ROW, (F.col("start") + F.col("s.a")).alias("a")).agg(F.max(F.col("start") + F.col("s.b")).alias("b"))
    merged = materialise(spans.repartition(ROW).sortWithinPartitions(ROW, "a").mapInPandas(_merged, f"{ROW} long, spans {SPANS}"), "spans", free=True)
    drop(packed, repeats)
    return merged


def _kept(text: str | None, spans) -> tuple[int, list[bytes]]:
    """Number of words, and those outside all spans."""
    words = words_of(text)
    if spans is None or not len(spans):
        return len(words), words
    out, at = [], 0
    for span in spans:
        out += words[at:span["a"]]
        at = span["b"]
    return len(words), out + words[at:]


def with_spans(docs: DataFrame, **how) -> DataFrame:
    """``row`` (all columns of ``docs``), and ``spans`` (null if nothing repeats)."""
    rows = numbered(docs.select(F.struct("*").alias("row")))
    found = find_repeats(rows.select(ROW, F.col("row.text").alias("text")), **how)
    return rows.join(found.hint("merge"), ROW, "left").select("row", "spans")


def remove_passages(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with repeated passages cut out of text: such texts become their kept words, joined by one space; others
    stay as they are. Other columns stay; n_chars, if there, is counted anew."""
    names = docs.columns

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"new": [
            text if spans is None else b" ".join(_kept(text, spans)[1]).decode("utf-8", "replace")
            for text, spans in zip(frame["text"], frame["spans"])]})

    rows = with_spans(docs, **how).select("row", F.col("row.text").alias("text"), "spans")
    out = beside(rows, ["row"], ["text", "spans"], row_by_row(cut), "new string")
    return out.select(*[
        F.col("new").alias("text") if n == "text"
        else F.coalesce(F.length("new"), F.lit(0)).cast(docs.schema[n].dataType).alias(n) if n == "n_chars"
        else F.col("row").getField(n).alias(n) for n in names])


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        found = [_kept(text, spans) for text, spans in zip(frame["text"], frame["spans"])]
        return pd.DataFrame({
            "n_words": [n for n, _ in found], "n_removed": [n - len(k) for n, k in found],
            "kept_sha256": [hashlib.sha256(b" ".join(k)).hexdigest() for _, k in found]})

    rows = with_spans(docs.select("doc_id", "text"), **how).select("row.doc_id", "row.text", "spans")
    return beside(rows, ["doc_id"], ["text", "spans"], row_by_row(go), "n_words long, n_removed long, kept_sha256 string")


OP4_SQL = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
), win as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)
), dup as (select s from win group by s having count(*) > 1
), gone as (
  select doc_id, list_distinct(flatten(list(range(i, i + 35)))) as places from win where s in (select s from dup) group by doc_id
), kept as (
  select doc_id, ws, case when places is null then ws else list_filter(
    list_transform(range(1, len(ws) + 1), lambda p: case when list_contains(places, p) then null else ws[p] end), lambda x: x is not null) end as k
  from w left join gone using (doc_id)
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - len(k) as bigint) as n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256
from kept
"""


@corpus_query("op4_passages", OP4_SQL)
def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
