"""Search for the threshold scales with a proven gap.

Both thresholds are monotone in u and v, so over a box of scales each loan's thresholds lie between their values at two
corners. That tells which regions a loan can fall into, and the cheapest of them bounds its cost from below. Sums over all
loans bound the cost and the size of the boundary of every choice in the box; boxes that cannot beat the best choice found
are left, the others are cut in four. One pass over the loans serves all open boxes; a task emits one row per box.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loantriad.operators.search import STRICT
from loantriad.session import settle, spread

PASS_BOXES = 2_000
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Certificate:
    """The best choice found and what no choice can beat; ``open_boxes`` 0 makes it final.

    No choice found: ``u``, ``v`` and ``boundary`` are None and the cost is infinite; with an infinite ``lower`` there is none.
    """

    u: float | None
    v: float | None
    cost: float
    boundary: int | None
    lower: float
    passes: int
    open_boxes: int

    @property
    def gap(self) -> float:
        return 0.0 if self.cost == self.lower else self.cost - self.lower


def _limits(pn, np_, u, v):
    keep, defer = pn - v * pn, v * pn
    top, bottom = keep + u * np_, defer + (np_ - u * np_)
    return np.where(top == 0, 1.0, keep / top), np.where(bottom == 0, 0.0, defer / bottom)


@dataclass(frozen=True)
class _Shared:
    """What is the same for every box over some rows: worked out once, not once a box."""

    bad: np.ndarray
    odd: np.ndarray
    at_pos: np.ndarray
    at_neg: np.ndarray
    least_pos: np.ndarray
    least_neg: np.ndarray

    @classmethod
    def of(cls, pn, np_, y) -> "_Shared":
        bad = y == 1
        odd = (pn < 0) | (np_ < 0)
        # where one loss is zero, a threshold's guard jumps within the box; where both are, the thresholds stay 1 and 0
        odd |= (pn == 0) ^ (np_ == 0)
        at_pos, at_neg = np.where(y == 0, pn, 0.0), np.where(bad, np_, 0.0)
        return cls(bad, odd, at_pos, at_neg, np.nan_to_num(at_pos), np.nan_to_num(at_neg))


def _price(p, pn, np_, y, u, v, shared: _Shared | None = None):
    """Realised cost and boundary size of one choice, as ``search.objectives`` counts them."""
    x = shared or _Shared.of(pn, np_, y)
    alpha, beta = _limits(pn, np_, u, v)
    pos = p >= alpha
    neg = ~pos & (p <= beta)
    bnd = ~pos & ~neg
    cost = np.where(pos, x.at_pos, np.where(neg, x.at_neg, np.where(x.bad, u * np_, v * pn)))
    return np.nansum(cost), bnd.sum()


def _bound(p, pn, np_, y, box: Box, shared: _Shared | None = None):
    """Least possible cost and boundary size within the box. Losses below zero break the order of the corners, so such
    a loan may fall into any region at any scale of the box; missing ones stay in the boundary."""
    u0, u1, v0, v1 = box
    x = shared or _Shared.of(pn, np_, y)
    odd = x.odd
    alpha_high, beta_low = _limits(pn, np_, u0, v0)
    alpha_low, beta_high = _limits(pn, np_, u1, v1)
    # rounding may turn the order of two nearly equal thresholds
    slack = 1e-12
    may_pos = (p >= alpha_low - slack) | odd
    must_pos = (p >= alpha_high + slack) & ~odd
    may_neg = ((p <= beta_high + slack) & ~must_pos) | odd
    must_low = (p <= beta_low - slack) & ~odd
    may_bnd = ~must_pos & ~must_low
    at_bnd = np.where(x.bad, np.minimum(u0 * np_, u1 * np_), np.minimum(v0 * pn, v1 * pn))
    far = np.inf
    least = np.minimum(np.where(may_pos, x.least_pos, far), np.where(may_neg, x.least_neg, far))
    least = np.minimum(least, np.where(may_bnd, np.nan_to_num(at_bnd), far))
    sure = ~may_pos & ~may_neg
    return least.sum(), sure.sum()


def _point(box: Box, eps: float) -> tuple[float, float]:
    """A choice of the box inside the triangle: the middle if it is, else the least corner."""
    u0, u1, v0, v1 = box
    u, v = (u0 + u1) / 2, (v0 + v1) / 2
    return (u, v) if u + v <= 1 - eps else (u0, v0)


def _pass(boxes: list[Box], eps: float):
    """Function for mapInArrow: bounds of one task over all boxes, and cost and boundary at one choice of each."""

    def run(batches):
        sums, rows = np.zeros((len(boxes), 4)), 0
        for batch in batches:
            p, pn, np_, y = (batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(4))
            rows += len(p)
            with np.errstate(divide="ignore", invalid="ignore"):
                shared = _Shared.of(pn, np_, y)
                for k, box in enumerate(boxes):
                    sums[k] += (*_bound(p, pn, np_, y, box, shared), *_price(p, pn, np_, y, *_point(box, eps), shared))
        if rows:
            columns = [pa.array(np.arange(len(boxes)), pa.int32()), *[pa.array(sums[:, j]) for j in range(4)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(boxes), rows), pa.int64())],
                                             names=["box", "low", "sure", "cost", "bnd", "n"])

    return run


def _quarters(box: Box, eps: float) -> list[Box]:
    u0, u1, v0, v1 = box
    u, v = (u0 + u1) / 2, (v0 + v1) / 2
    return [b for b in ((u0, u, v0, v), (u, u1, v0, v), (u0, u, v, v1), (u, u1, v, v1)) if b[0] + b[2] <= 1 - eps]


def certified_search(
    df: DataFrame, share: float = 0.05, tolerance: float = 0.01, passes: int = 30, eps: float = STRICT, p: str = "p_default", y: str = "y",
) -> Certificate:
    """Least realised cost of all (u, v) with u + v <= 1 - eps and at most ``share`` of the loans in the boundary.

    Ends when no choice can be cheaper than the one found by more than ``tolerance`` (relative), or after ``passes``
    passes; the gap reported is proven either way. Boxes wait their turn, least bound first; none is dropped. Missing
    scores and losses leave a loan in the boundary; no loans give cost 0 at (0, 0).
    """
    narrow = spread(settle(df.select(*[F.col(c).cast("double") for c in (p, "lam_pn", "lam_np", y)])))
    schema = "box int, low double, sure double, cost double, bnd double, n long"
    waiting: list[tuple[float, Box]] = [(0.0, (i / 8, (i + 1) / 8, j / 8, (j + 1) / 8)) for i in range(8) for j in range(8 - i)]
    best, done = (np.inf, None, None, None), 0

    def beats(low: float) -> bool:
        return low < best[0] - tolerance * abs(best[0]) if best[1] is not None else True

    left = np.inf  # the least bound among boxes left because they gain less than the tolerance
    while done < passes:
        waiting.sort()
        now, waiting = [b for _, b in waiting[:PASS_BOXES]], waiting[PASS_BOXES:]
        if not now:
            break
        totals = narrow.mapInArrow(_pass(now, eps), schema).groupBy("box").agg(*[F.sum(c).alias(c) for c in ("low", "sure", "cost", "bnd", "n")])
        rows = totals.collect()  # one row per box
        done += 1
        if not rows:
            return Certificate(0.0, 0.0, 0.0, 0, 0.0, done, 0)
        for r in rows:
            if r.bnd <= share * r.n:
                u, v = _point(now[r.box], eps)
                best = min(best, (r.cost, u, v, int(r.bnd)), key=lambda b: (b[0], b[1] is None, b[1] or 0, b[2] or 0))
        fresh = [(r.low, q) for r in rows if r.sure <= share * r.n for q in _quarters(now[r.box], eps)]
        kept = [(low, b) for low, b in [*waiting, *fresh] if beats(low)]
        left = min([left, *[low for low, _ in [*waiting, *fresh] if not beats(low)]])
        waiting = kept
    lower = min([left, best[0], *[low for low, _ in waiting]])
    return Certificate(best[1], best[2], float(best[0]), best[3], float(lower), done, len(waiting))
