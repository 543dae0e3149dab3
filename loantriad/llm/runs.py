"""Periodic runs of words, found by an enhanced suffix array (suffix order, its inverse, LCP intervals) without a tree.

A run is a longest stretch of words that repeats with a smallest period. A square (two equal neighbours of length d) that
cannot move one word to the right branches: the suffixes at its start and middle part after exactly d words, so both lie in an
LCP interval of depth d, in different children of it. For every interval the suffixes of all children but the largest are
tested: is the suffix d words further on, or d words back, in the interval too, by its place in the suffix order? Each
suffix is tested once for each halving of its interval, so tests stay within n log n. A branching square is the right end of
its run: it is rotated to the left as long as words agree, and squares that end together are merged into the run of their
smallest period.

Texts are sorted together, some ``BATCH_WORDS`` words at a time: the first key is (text, word), so no suffix meets one of
another text, and prefix doubling goes on with undecided suffixes only. A longer text is a batch of its own.
Only runs of ``MIN_COPIES`` copies and ``MIN_WORDS`` words are reported; such a run has its last MIN_COPIES copies in one
interval, which is asked of each square before it is rotated.

Defined results: null or empty text has no words and no runs; equal rows get equal results; a null doc_id stays null;
an empty table gives an empty table. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loantriad.llm.common import WORD_GAP, beside, table, words_of
from loantriad.llm.registry import corpus_query

MIN_COPIES = 4
MIN_WORDS = 6
BATCH_WORDS = 60_000

Run = tuple[int, int, int]  # start, length, period


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for h = 1, 2, 4 ... the rank of each place by its first h codes (one more entry, -1, at the end).

    A rank is the first place of its class in the order.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    levels, h = [], 1
    ranks = np.full(n + 1, -1, np.int64)
    sorted_codes = codes[order]
    fresh = np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels.append(ranks.astype(np.int32))
    slots = _undecided(fresh)
    while len(slots):
        members = order[slots]
        far = np.minimum(members + h, n)
        key = ranks[members] * (n + 2) + ranks[far] + 1
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[slots] = members
        new = np.concatenate([[True], key[1:] != key[:-1]])
        ranks[members] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(ranks.astype(np.int32))
        slots = slots[_undecided(new)]
        h *= 2
    return order, levels


def _undecided(fresh: np.ndarray) -> np.ndarray:
    """Places of classes with more than one member, by the marks of first members."""
    alone = fresh & np.concatenate([fresh[1:], [True]])
    return np.flatnonzero(~alone)


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the one before it in the order; the first has 0."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    at = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b, total = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = same.astype(np.int64) << k
        a, b, total = a + step, b + step, total + step
    lcp[at] = total
    return lcp


def intervals(lcp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """depth, first and last place of each LCP interval among ``places`` (ascending, whole classes of first words), and for
    each place the interval that it splits (-1: none)."""
    depth, low, high = [], [], []
    owner = np.full(len(places), -1, np.int64)
    stack: list[tuple[int, int, int]] = []  # depth, first place, number
    before = -1
    for k, (place, d) in enumerate(zip(places.tolist(), lcp[places].tolist())):
        first = before
        while stack and stack[-1][0] > d:
            _, first, number = stack.pop()
            high[number] = before
        before = place
        if d == 0:
            continue
        if not stack or stack[-1][0] < d:
            stack.append((d, first, len(depth)))
            depth.append(d)
            low.append(first)
            high.append(-1)
        owner[k] = stack[-1][2]
    for _, _, number in stack:
        high[number] = before
    return np.array(depth, np.int64), np.array(low, np.int64), np.array(high, np.int64), owner


def smaller_children(depth, low, high, places, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, first, last place) of all children but the largest of each interval."""
    inside = owner >= 0
    by = np.argsort(owner[inside], kind="stable")
    number, split = owner[inside][by], places[inside][by]
    # an interval's children begin at its first place and at each of its splits
    begins = np.concatenate([low, split])
    numbers = np.concatenate([np.arange(len(low)), number])
    by = np.lexsort([begins, numbers])
    begins, numbers = begins[by], numbers[by]
    last_child = np.concatenate([numbers[1:] != numbers[:-1], [True]])
    ends = np.where(last_child, high[numbers], np.concatenate([begins[1:], [0]]) - 1)
    sizes = ends - begins + 1
    by = np.lexsort([-sizes, numbers])
    largest = by[np.concatenate([[True], numbers[by][1:] != numbers[by][:-1]])]
    rest = np.ones(len(begins), bool)
    rest[largest] = False
    return numbers[rest], begins[rest], ends[rest]


def branching_squares(codes: np.ndarray, copies: int = MIN_COPIES) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of the branching squares at whose end ``copies`` copies stand."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(codes)
    if n < copies:
        return none
    order, levels = suffix_order(codes)
    lcp = common_prefixes(order, levels)
    # a run's first suffix shares (copies - 1) periods with another: only classes of first words with such an LCP can hold one
    heads = np.flatnonzero(lcp == 0)
    sizes = np.diff(heads, append=n)
    wanted = (sizes >= copies) & (np.maximum.reduceat(lcp, heads) >= copies - 1)
    places = np.flatnonzero(np.repeat(wanted, sizes))
    if not len(places):
        return none
    depth, low, high, owner = intervals(lcp, places)
    number, first, last = smaller_children(depth, low, high, places, owner)
    large = high[number] - low[number] + 1 >= copies
    number, first, last = number[large], first[large], last[large]
    if not len(number):
        return none
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    found = []
    counts = last - first + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    a = 0
    while a < len(number):  # some million tests at a time
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 2_000_000, side="right")) - 1)
        each = np.repeat(np.arange(a, b), counts[a:b])
        place = np.arange(bounds[a], bounds[b]) - bounds[each] + first[each]
        i, d, node = order[place], depth[number[each]], number[each]
        for start, other in ((i, i + d), (i - d, i - d)):
            ok = (other >= 0) & (other < n)
            where = inverse[np.where(ok, other, 0)]
            ok &= (where >= low[node]) & (where <= high[node]) & ((where < first[each]) | (where > last[each]))
            start, period, home = start[ok], d[ok], node[ok]
            for back in range(1, copies - 1):  # earlier copies lie in the interval as well
                other = start - back * period
                ok = other >= 0
                where = inverse[np.where(ok, other, 0)]
                ok &= (where >= low[home]) & (where <= high[home])
                start, period, home = start[ok], period[ok], home[ok]
            found.append(np.stack([start + 2 * period, period]))
        a = b
    squares = np.unique(np.concatenate(found, axis=1), axis=1)
    return squares[0], squares[1]


def runs_of(codes: np.ndarray, copies: int = MIN_COPIES, words: int = MIN_WORDS) -> list[Run]:
    """Runs of at least ``copies`` copies and ``words`` words, by start, then period."""
    ends, periods = branching_squares(codes, copies)
    runs: list[Run] = []
    here: list[tuple[int, int]] = []  # start, period of runs that end at ``last``
    last = -1
    for end, period in zip(ends.tolist(), periods.tolist()):  # by end, then period
        if end != last:
            here, last = [], end
        if any(period % q == 0 and start <= end - 2 * period for start, q in here):
            continue  # several copies of a smaller period
        start = _rotated(codes, end - 2 * period, period)
        here.append((start, period))
        if end - start >= max(words, copies * period):
            runs.append((start, end - start, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _rotated(codes: np.ndarray, start: int, period: int) -> int:
    """Start of the leftmost square that rotation of the square at ``start`` reaches."""
    step = 16
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(codes[low:start] != codes[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return 0


def batch_runs(texts: list[list], copies: int = MIN_COPIES, words: int = MIN_WORDS) -> list[list[Run]]:
    """Runs of each list of words; all lists are sorted together."""
    numbers: dict = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in texts for w in ws), np.int64)
    sizes = np.array([len(ws) for ws in texts], np.int64)
    flat += np.repeat(np.arange(len(texts)), sizes) * max(len(numbers), 1)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in runs_of(flat, copies, words):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        out[k].append((start - int(begins[k]), length, period))
    return out


def kept_words(words: list, runs: list[Run]) -> list:
    """Words that lie in no run behind the run's first period."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period:start + length] = True
    return [w for w, d in zip(words, drop.tolist()) if not d]


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _find(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    pending, size, first = [], 0, 0
    for place, text in enumerate(frame["text"]):
        words = words_of(text)
        if pending and size + len(words) > BATCH_WORDS:
            yield _found(pending, first)
            pending, size, first = [], 0, place
        pending.append(words)
        size += len(words)
    if pending:
        yield _found(pending, first)


def _found(texts: list[list[bytes]], first: int) -> pd.DataFrame:
    runs = batch_runs(texts)
    return pd.DataFrame({
        "at": np.arange(first, first + len(texts)), "n_words": [len(ws) for ws in texts],
        "runs": [[{"start": s, "length": n, "period": q} for s, n, q in rs] for rs in runs],
        "collapsed": [b" ".join(kept_words(ws, rs)).decode("utf-8", "replace") for ws, rs in zip(texts, runs)]})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text with each run cut to its first period, of every row."""
    return beside(docs, ["doc_id"], ["text"], lambda: _find, RUNS)


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten goes on periodically from a word on, as the contract of the query says.

    A row without doc_id or words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).select(
        "doc_id", "text", F.floor(F.col("h") / 10).alias("g"),
        F.when(F.col("h") % 10 == 0, word_array(F.col("text"))).alias("words"))
    n = F.size("words")
    sized = chosen.select("doc_id", "text", "words", "g", F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    period = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    placed = sized.select("doc_id", "text", "words", "a", period.alias("p"))
    copied = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(copied, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as numbers and hashes: the longest run (ties: smallest start, then period) and all of them."""
    # runs come by start, then period: the first of the greatest length is the one asked for
    longest = F.array_max(F.transform("runs", lambda r: r.length))
    top = F.get(F.filter("runs", lambda r: r.length == F.col("longest")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("longest", longest).withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@corpus_query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
