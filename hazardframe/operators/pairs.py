"""Sums over ordered pairs of rows without making the pairs.

For each case, the rows that come earlier are wanted, weighed 1 if their risk is
smaller, one half if equal. Time and risk are cut into ranges: whole cells of
earlier ranges of time and smaller ranges of risk come from a table of prefix sums,
rows of the case's own range of time from one task per range, and rows of its own
range of risk from another. A task counts by merging, in about n log^2 n steps, so
the work grows almost with the rows, where a join would grow with their square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.functions import steps_below

#: Rows that a task should hold, and ranges of time and of risk at most.
TASK_ROWS, MOST_RANGES = 500_000, 256


def earlier_smaller(order: np.ndarray, rank: np.ndarray, case: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each case, the weight of other rows earlier in ``order`` with a smaller rank, plus half of those with an equal one.

    ``order`` sorts the rows (no ties between cases and others); the rows are
    merged in halves, and at each step the cases of the right halves look their
    rank up among the others of the left ones.
    """
    at = np.argsort(order, kind="stable")
    rank, case, weight = rank[at].astype(np.int64), case[at], weight[at]
    n, top = rank.size, int(rank.max(initial=0)) + 2
    out = np.zeros(n)
    place = np.arange(n)
    size = 1
    while size < n:
        half = place // size
        left = np.flatnonzero((half % 2 == 0) & ~case)
        right = np.flatnonzero((half % 2 == 1) & case)
        if left.size and right.size:
            key = (half[left] // 2) * top + rank[left]
            by = np.argsort(key, kind="stable")
            key, sums = key[by], np.append(0.0, np.cumsum(weight[left][by]))
            group = (half[right] // 2) * top
            asked = group + rank[right]
            start = sums[np.searchsorted(key, group, side="left")]
            below = sums[np.searchsorted(key, asked, side="left")] - start
            upto = sums[np.searchsorted(key, asked, side="right")] - start
            out[right] += (below + upto) / 2
        size *= 2
    back = np.empty(n)
    back[at] = out
    return back


def ranges_for(df: DataFrame) -> int:
    """Ranges that leave a task its number of rows."""
    return max(1, min(MOST_RANGES, math.ceil(2 * df.count() / TASK_ROWS)))


def _edges(df: DataFrame, column: str, ranges: int) -> list[float]:
    cuts = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.agg(F.percentile_approx(column, cuts, 1000).alias("e")).first().e or [])) if ranges > 1 else []


def _merge(time: str, inclusive: bool, with_total: bool):
    """A task's sums: over cases, weight times that of earlier rows, by risk and in all."""

    def run(table: pa.Table) -> pa.Table:
        t, r, w, case = (table.column(c).to_numpy() for c in (time, "r", "w", "k"))
        case = case == 1
        first = case if not inclusive else ~case  # who comes first at equal times
        order = np.empty(t.size, dtype=np.int64)
        order[np.lexsort((~first, t))] = np.arange(t.size)
        rank = np.unique(r, return_inverse=True)[1]
        near = earlier_smaller(order, rank, case, w)
        total = 0.0
        if with_total:
            sums = np.zeros(t.size + 1)
            by = np.argsort(order)
            np.cumsum(np.where(case[by], 0.0, w[by]), out=sums[1:])
            total = float((w[case] * sums[order[case]]).sum())
        return pa.table({"num": [float((w[case] * near[case]).sum())], "den": [total]})

    return run


def earlier_pairs(cases: DataFrame, others: DataFrame, inclusive: bool = False, ranges: int = 1) -> DataFrame:
    """``num, den`` over cases (``t, r, w``) and the others that are earlier (or, ``inclusive``, no later).

    ``den`` sums the products of weights, ``num`` those times 1, 1/2 or 0 as the
    other's risk is smaller, equal or larger.
    """
    both = cases.select("t", "r", "w", F.lit(1).alias("k")).unionAll(others.select("t", "r", "w", F.lit(0).alias("k")))
    both = both.groupBy("t", "r", "k").agg(F.sum("w").cast("double").alias("w"))
    times, risks = _edges(both, "t", ranges), _edges(both, "r", ranges)
    place = lambda e, c: (steps_below(e, F.col(c)) if e else F.lit(0)).cast("int")
    placed = both.withColumns({"tb": place(times, "t"), "rb": place(risks, "r")})
    schema = "num double, den double"
    own_time = placed.groupBy("tb").applyInArrow(_merge("t", inclusive, True), schema)
    if ranges == 1:
        return own_time
    own_risk = placed.groupBy("rb").applyInArrow(_merge("tb", False, False), schema)
    # a row a cell; earlier ranges of time and smaller ranges of risk as prefix sums
    cells = placed.where("k = 0").groupBy("tb", "rb").agg(F.sum("w").alias("v"))
    nt, nr = len(times) + 1, len(risks) + 1
    grid = np.zeros((nt, nr))
    for c in cells.collect():
        grid[c.tb, c.rb] = c.v
    before = np.zeros((nt + 1, nr + 1))
    before[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)
    table = [(i, j, float(before[i, j]), float(before[i, nr])) for i in range(nt) for j in range(nr)]
    prefix = placed.sparkSession.createDataFrame(table, "tb int, rb int, smaller double, every double")
    whole = placed.where("k = 1").groupBy("tb", "rb").agg(F.sum("w").alias("v")).join(F.broadcast(prefix), ["tb", "rb"])
    far = whole.agg(F.coalesce(F.sum(F.col("v") * F.col("smaller")), F.lit(0.0)).alias("num"), F.coalesce(F.sum(F.col("v") * F.col("every")), F.lit(0.0)).alias("den"))
    return own_time.unionAll(own_risk).unionAll(far)


def equal_time_pairs(cases: DataFrame, others: DataFrame) -> DataFrame:
    """``num, den`` over cases and the others of the same time, by running sums over risk within a time."""
    both = cases.select("t", "r", F.col("w").alias("a"), F.lit(0.0).alias("b")).unionAll(others.select("t", "r", F.lit(0.0).alias("a"), F.col("w").alias("b")))
    per = both.groupBy("t", "r").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = F.sum("b").over(Window.partitionBy("t").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("b").over(Window.partitionBy("t"))
    per = per.withColumns({"u": upto, "e": every})
    return per.agg(F.coalesce(F.sum(F.col("a") * (F.col("u") - F.col("b") / 2)), F.lit(0.0)).alias("num"), F.coalesce(F.sum(F.col("a") * F.col("e")), F.lit(0.0)).alias("den"))


def own_group_pairs(cases: DataFrame, others: DataFrame, meets) -> DataFrame:
    """``num, den`` over the pairs of one group (``g``), which are few, that ``meets`` admits."""
    joined = cases.join(others, (cases.g == others.g2) & meets(cases, others))
    agrees = F.when(F.col("r") > F.col("r2"), 1.0).when(F.col("r") == F.col("r2"), 0.5).otherwise(0.0)
    w = F.col("w") * F.col("w2")
    return joined.agg(F.coalesce(F.sum(w * agrees), F.lit(0.0)).alias("num"), F.coalesce(F.sum(w), F.lit(0.0)).alias("den"))
