"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt by nearness: each goes to the cell of its nearest pivot (a bounded set of the vectors themselves), and a cell
with more than ``SHARD_ROWS`` is split into shards by id. A shard's tree halves its vectors by the widest of a few
directions until a ball holds ``LEAF`` of them. For a query q, no vector in a ball with centre c and radius r scores
above q.c + |q| r; nodes are taken from a heap by that bound, for a block of queries at once, and left by every query
whose k-th score so far is above it. There are three rounds, and the k-th score travels on: first each query searches the
shard that it lies in, then the ``FIRST_CELLS`` cells with the greatest bounds, then every further cell whose bound still
reaches its k-th score. Cells that can't are left before anything is shuffled. A shard streams its queries in
blocks, so a task holds one tree and one block, however many queries there are. No pair of query and vector is ever a
row; a shard hands on at most k rows a query.

Scores are exact: components are whole numbers, products are taken in doubles where no sum can pass 2^53, else in whole
64-bit numbers. Ties go to the smaller id, also across shards, since a node is left only if its bound is below the k-th
score.

Defined results: vectors that are null, or hold nulls or non-finite numbers, take no part; vectors of another length
than the query's aren't compared with it; rows without id take no part; of rows with one id the least vector counts
once; a query with fewer than k candidates gets all; an empty table gives an empty table. Only vec_id and embedding are
read. Vectors of a length that no pivot has form cells without a bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from loantriad.llm.common import table
from loantriad.llm.registry import corpus_query
from loantriad.session import materialise

K = 20
SHARD_ROWS = 8_192
LEAF = 128
QUERY_BLOCK = 256
FIRST_CELLS = 4
#: All pivots together; they go to every task.
PIVOT_BYTES = 64 << 20
DEAL_STEP = 2_000_000  # distances held at once
QUERY_STEP = 20
SCALE = 64
#: Below every score: no candidate.
NONE = -(1 << 62)


class BallTree:
    """Nodes as arrays; the vectors of a node lie side by side."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.exact = None
        dims = vectors.shape[1] if vectors.ndim == 2 else 0
        if len(ids) and dims and dims * float(np.abs(self.vectors).max()) ** 2 >= 2 ** 52:
            self.exact = vectors[order].astype(np.int64)
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, begin, end, left, right
        self.k, self.leaf = k, leaf
        if len(ids):
            self._build(0, len(ids))

    def _build(self, begin: int, end: int) -> int:
        part = self.vectors[begin:end]
        centre = part.mean(axis=0)
        away = part - centre
        radius = float(np.sqrt((away ** 2).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append((centre, radius * (1 + 1e-9) + 1e-9, begin, end, -1, -1))
        if end - begin > self.leaf and radius > 0:
            far = part[np.argmax((away ** 2).sum(axis=1))]
            other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
            along = part @ (other - far)
            half = (end - begin) // 2
            order = np.argpartition(along, half)
            for rows in (self.ids, self.vectors, self.exact):
                if rows is not None:
                    rows[begin:end] = rows[begin:end][order]
            left = self._build(begin, begin + half)
            right = self._build(begin + half, end)
            self.nodes[at] = (*self.nodes[at][:4], left, right)
        elif radius == 0 and end - begin > self.k + 1:
            # equal vectors score alike: only the k + 1 least ids can be among the best (one may be the query's own)
            order = np.argsort(self.ids[begin:end])
            self.ids[begin:end] = self.ids[begin:end][order]
            self.nodes[at] = (centre, 1e-9, begin, begin + self.k + 1, -1, -1)
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k per query, least id first among equals; -1 where there are none.

        ``floor`` is a score that k other vectors reach already: lower ones aren't needed.
        """
        n, k = len(query_ids), self.k
        best = np.full((n, k), NONE, np.int64)
        who = np.full((n, k), -1, np.int64)
        kth = floor.copy()
        if not self.nodes or not n:
            return who, best
        q = queries.astype(np.float64)
        exact = self.exact is not None or q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) >= 2 ** 52
        whole = self.exact if self.exact is not None else (self.vectors.astype(np.int64) if exact else None)
        norms = np.sqrt((q ** 2).sum(axis=1))

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            upper = q[rows] @ centre + norms[rows] * radius
            return upper + 1e-9 * np.abs(upper) + 1e-6

        rows = np.arange(n)
        first = bound(0, rows)
        heap = [(-float(first.max()), 0, rows, first)]
        while heap:
            _, node, rows, upper = heapq.heappop(heap)
            rows = rows[upper >= kth[rows]]
            if not len(rows):
                continue
            _, _, begin, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    upper = bound(child, rows)
                    near = upper >= kth[rows]
                    if near.any():
                        heapq.heappush(heap, (-float(upper[near].max()), child, rows[near], upper[near]))
                continue
            scores = queries[rows].astype(np.int64) @ whole[begin:end].T if exact else (q[rows] @ self.vectors[begin:end].T).astype(np.int64)
            ids = self.ids[begin:end]
            scores[query_ids[rows][:, None] == ids[None, :]] = NONE
            merged = np.concatenate([best[rows], scores], axis=1)
            names = np.concatenate([who[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
            order = np.lexsort((names, -merged), axis=1)[:, :k]
            best[rows] = np.take_along_axis(merged, order, 1)
            who[rows] = np.take_along_axis(names, order, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])
        who[best == NONE] = -1
        return who, best


FOUND = "query_id long, vec_id long, score long"


def _rows(query_ids: np.ndarray, who: np.ndarray, best: np.ndarray, floor: np.ndarray) -> pd.DataFrame:
    there = (best >= floor[:, None]) & (best != NONE)
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, there.sum(axis=1)), "vec_id": who[there], "score": best[there]})


def _home(k: int, leaf: int):
    """Each query in its own shard."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = frame["vec_id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy())
        tree = BallTree(ids, vectors, k, leaf)
        out = []
        asked = np.flatnonzero(frame["asked"].to_numpy(bool))
        for at in range(0, len(asked), QUERY_BLOCK):
            some = asked[at:at + QUERY_BLOCK]
            floor = np.full(len(some), NONE, np.int64)
            out.append(_rows(ids[some], *tree.search(ids[some], vectors[some], floor), floor))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def _away(k: int, leaf: int):
    """Rows come sorted by shard, a shard's vectors before the queries that visit it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, parts, tree = None, [], None
        for frame in frames:
            keys = frame[["dims", "shard"]].drop_duplicates()
            for key in keys.itertuples(index=False):
                here = frame[(frame["dims"] == key.dims) & (frame["shard"] == key.shard)]
                if shard != key:
                    shard, parts, tree = key, [], None
                vectors = here[~here["visit"]]
                if len(vectors):
                    parts.append((vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["v"].to_numpy())))
                visits = here[here["visit"]]
                if not len(visits):
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k, leaf) if parts else BallTree(
                        np.empty(0, np.int64), np.empty((0, key.dims), np.int64), k, leaf)
                    parts = []
                ids, q = visits["vec_id"].to_numpy(np.int64), np.stack(visits["v"].to_numpy())
                floor = visits["floor"].to_numpy(np.int64)
                for at in range(0, len(ids), QUERY_BLOCK):
                    cut = slice(at, at + QUERY_BLOCK)
                    yield _rows(ids[cut], *tree.search(ids[cut], q[cut], floor[cut]), floor[cut])

    return run


def _deal(pivots: dict[int, np.ndarray]):
    """Number of the nearest pivot among those of the vector's length, and its distance; -1 where there are none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, far = np.full(len(frame), -1), np.zeros(len(frame))
            dims = frame["dims"].to_numpy()
            for d in np.unique(dims):
                if d not in pivots:
                    continue
                points = pivots[d]
                half = 0.5 * (points ** 2).sum(axis=1)
                rows = np.flatnonzero(dims == d)
                step = max(1, DEAL_STEP // max(len(points), d))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    x = np.stack(frame["v"].iloc[some].to_numpy()).astype(np.float64)
                    cell[some] = (half - x @ points.T).argmin(axis=1)
                    far[some] = np.sqrt(((x - points[cell[some]]) ** 2).sum(axis=1))
            yield frame.assign(cell=cell.astype("int32"), far=far)

    return run


class Cells:
    """Pivots, radii and shards of the cells of one vector length: a few numbers for each pivot."""

    def __init__(self, points: np.ndarray | None, stats: list):
        self.points = None if points is None else points[[r.cell for r in stats]]
        self.radius = np.array([r.radius for r in stats]) * (1 + 1e-9) + 1e-9
        self.first = np.array([r.first for r in stats])
        self.subs = np.array([r.subs for r in stats])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of the cell scores above this; a row per query, a column per cell."""
        if self.points is None:
            return np.full((len(q), len(self.first)), np.inf)
        norms = np.sqrt((q ** 2).sum(axis=1))[:, None]
        size = norms * (np.sqrt((self.points ** 2).sum(axis=1)) + self.radius)
        return q @ self.points.T + norms * self.radius + 1e-9 * size + 1e-6


def _visits(cells: dict[int, Cells], nearest: bool, first_cells: int):
    """(query, shard) visits of the ``first_cells`` cells with the greatest bounds, or of all others that still matter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dims = frame["dims"].to_numpy()
            for d in np.unique(dims):
                known = cells[d]
                rows = np.flatnonzero(dims == d)
                step = max(1, DEAL_STEP // max(len(known.first), d, 1))
                for at in range(0, len(rows), step):
                    part = frame.iloc[rows[at:at + step]]
                    bound = known.bounds(np.stack(part["v"].to_numpy()).astype(np.float64).reshape(len(part), -1))
                    top = np.zeros(bound.shape, bool)
                    np.put_along_axis(top, np.argsort(-bound, axis=1, kind="stable")[:, :first_cells], True, axis=1)
                    row, cell = np.nonzero((bound >= part["floor"].to_numpy()[:, None]) & (top == nearest))
                    times = known.subs[cell]
                    begin = np.cumsum(times) - times
                    shard = np.repeat(known.first[cell] - begin, times) + np.arange(int(times.sum()))
                    out = part.iloc[np.repeat(row, times)].assign(to=shard.astype("int32"))
                    yield out[out["to"] != out["shard"]][["dims", "to", "vec_id", "v", "floor"]]

    return run


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times ``scale`` rounded down; unusable vectors and repeated ids are left out."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return (embeddings.select("vec_id", "embedding").where(usable)
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
            .select(F.col("vec_id").cast("long"), F.transform("embedding", lambda e: F.floor(e.cast("double") * scale)).alias("v")))


def top_k(vectors: DataFrame, asked, k: int = K, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` other vectors of each row for which the column ``asked`` holds.

    ``vectors``: vec_id, v (array<long>), each id once.
    """
    return _search(deal(vectors, asked, shard_rows), k, leaf)[0]


def deal(vectors: DataFrame, asked, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict[int, Cells]]:
    """(vectors with their shard, what is known of the cells of each vector length)."""
    spark = vectors.sparkSession
    kind = "vec_id long, v array<long>, asked boolean, dims int"
    plain = materialise(vectors.select("vec_id", "v", F.coalesce(asked, F.lit(False)).alias("asked"), F.size("v").alias("dims")), "vectors")
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("widest")).first()
    most = max(1, min(-(-size.n // shard_rows), PIVOT_BYTES // (8 * max(size.widest or 1, 1))))
    pivots: dict[int, list] = {}
    for r in plain.where("dims > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("dims", "v").collect():
        pivots.setdefault(r.dims, []).append(r.v)
    points = {d: np.array(p, np.float64) for d, p in pivots.items()}
    dealt = materialise(plain.mapInPandas(_deal(points), f"{kind}, cell int, far double"), "dealt")
    found = dealt.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).orderBy("dims", "cell").collect()
    first, stats = 0, {}
    for r in found:
        subs = -(-r.n // shard_rows)
        stats.setdefault(r.dims, []).append(Row(cell=r.cell, radius=r.radius, first=first, subs=subs))
        first += subs
    split = spark.createDataFrame([(d, r.cell, r.first, r.subs) for d, rs in stats.items() for r in rs], "dims int, cell int, first int, subs int")
    stored = dealt.join(F.broadcast(split), ["dims", "cell"]).select(  # one row per pivot
        "dims", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "subs")).cast("int").alias("shard"), "vec_id", "v", "asked")
    return materialise(stored, "shards"), {d: Cells(points.get(d), rs) for d, rs in stats.items()}


def _search(dealt: tuple[DataFrame, dict[int, Cells]], k: int, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """(the best k of each query, the visits of the second and third round)."""
    stored, cells = dealt
    shards = max(1, sum(int(c.subs.sum()) for c in cells.values()))
    found = materialise(stored.groupBy("dims", "shard").applyInPandas(_home(k, leaf), FOUND), "home")
    own = stored.select("dims", "shard", F.lit(False).alias("visit"), "vec_id", "v", F.lit(NONE).alias("floor"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    rounds = []
    for nearest in (True, False):
        # found holds each pair once, so the k-th best of it is reached by k other vectors
        ranked = found.withColumn("rank", F.row_number().over(by_score))
        kth = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        asking = stored.where("asked").join(kth, "vec_id", "left").select(
            "dims", "shard", "vec_id", "v", F.coalesce("floor", F.lit(NONE)).alias("floor"))
        visits = materialise(asking.mapInPandas(_visits(cells, nearest, FIRST_CELLS), "dims int, to int, vec_id long, v array<long>, floor long"), "visits")
        rounds.append(visits)
        rows = own.unionByName(visits.select("dims", F.col("to").alias("shard"), F.lit(True).alias("visit"), "vec_id", "v", "floor"))
        away = rows.repartition(shards, "dims", "shard").sortWithinPartitions("dims", "shard", "visit").mapInPandas(_away(k, leaf), FOUND)
        found = found.unionByName(materialise(away, "away"))
    best = found.select("query_id", F.row_number().over(by_score).alias("rank"), "vec_id", "score")
    return best.where(F.col("rank") <= k), rounds


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda e: cast(floor(64 * cast(e as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""


@corpus_query("op3_exact_top_k", OP3_SQL)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % QUERY_STEP == 0)
