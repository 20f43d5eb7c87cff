"""A forest as arrays, for routing and averaging in Arrow batches.

The model is broadcast; rows are routed and the values of their leaves averaged in
one pass without a shuffle, where the join of rows with leaves would move every
row once per tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of leaf values that a task keeps between batches.
KEPT = 64 << 20


@dataclass
class TreeArrays:
    feature: np.ndarray
    threshold: np.ndarray
    missing: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    n_leaves: int
    jump_leaf: np.ndarray
    jump_t: np.ndarray
    jump_cause: np.ndarray
    jump: np.ndarray

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaves of the rows of ``x`` (rows by features, NaN missing)."""
        at = np.zeros(x.shape[0], dtype=np.int64)
        todo = np.flatnonzero(self.leaf[at] < 0)
        while todo.size:
            n = at[todo]
            v = x[todo, self.feature[n]]
            gone = np.isnan(v)
            left = np.where(self.missing[n] == 2, gone, np.where(gone, self.missing[n] == 1, v <= self.threshold[n]))
            at[todo] = np.where(left, self.left[n], self.right[n])
            todo = todo[self.leaf[at[todo]] < 0]
        return self.leaf[at]


@dataclass
class ForestArrays:
    trees: list[TreeArrays]
    features: list[str]
    event_times: np.ndarray
    n_causes: int
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}


def cumulative(tree: TreeArrays, times: np.ndarray, cause: int | None = None) -> np.ndarray:
    """Cumulative hazards of the leaves (leaves by times)."""
    out = np.zeros((tree.n_leaves, times.size + 1))
    use = slice(None) if cause is None else tree.jump_cause == cause
    np.add.at(out, (tree.jump_leaf[use], np.searchsorted(times, tree.jump_t[use])), tree.jump[use])
    return np.cumsum(out[:, :-1], axis=1)


def increments(tree: TreeArrays, grid: np.ndarray, n_causes: int) -> np.ndarray:
    """Hazard increments of the leaves on the grid of event times (leaves, causes, times)."""
    out = np.zeros((tree.n_leaves, n_causes, grid.size))
    np.add.at(out, (tree.jump_leaf, tree.jump_cause - 1, np.searchsorted(grid, tree.jump_t)), tree.jump)
    return out


def incidence(steps: np.ndarray, grid: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Product limits of increments (n, causes, grid): (n, 1 + causes, times), survival first."""
    surv = np.cumprod(np.maximum(0.0, 1 - steps.sum(axis=1)), axis=1)
    before = np.concatenate([np.ones((steps.shape[0], 1)), surv[:, :-1]], axis=1)
    both = np.concatenate([surv[:, None], np.cumsum(steps * before[:, None], axis=2)], axis=1)
    start = np.zeros(both.shape[:2] + (1,))
    start[:, 0] = 1
    return np.concatenate([start, both], axis=2)[:, :, np.searchsorted(grid, times, side="right")]


def leaf_values(forest: ForestArrays, what: str, times: np.ndarray) -> Callable[[int], np.ndarray]:
    """A function from a tree's number to its leaves' values (leaves by width)."""
    grid = forest.event_times

    def make(b: int) -> np.ndarray:
        tree = forest.trees[b]
        if what == "mortality":
            return cumulative(tree, times).sum(axis=1, keepdims=True)
        if what in ("cumhaz", "survival"):
            return cumulative(tree, times)
        if what == "cause_cumhaz":
            return np.concatenate([cumulative(tree, times, j + 1) for j in range(forest.n_causes)], axis=1)
        if what == "cif":
            return incidence(increments(tree, grid, forest.n_causes), grid, times).reshape(tree.n_leaves, -1)
        return increments(tree, grid, forest.n_causes).reshape(tree.n_leaves, -1)  # cif_hazard

    def get(b: int) -> np.ndarray:
        key = (what, times.tobytes(), b)
        if key not in forest.cache:
            made = make(b)
            if sum(v.nbytes for v in forest.cache.values()) + made.nbytes > KEPT:
                return made
            forest.cache[key] = made
        return forest.cache[key]

    return get


def average(forest: ForestArrays, x: np.ndarray, what: str, times: np.ndarray, allowed: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, trees used): means over all trees, or over each row's ``allowed`` ones; NaN without a tree."""
    get = leaf_values(forest, what, times)
    total, used = None, np.zeros(x.shape[0])
    member = None
    if allowed is not None:
        member = np.zeros((x.shape[0], len(forest.trees)), dtype=bool)
        for i, trees in enumerate(allowed):
            member[i, np.asarray(trees if trees is not None else [], dtype=np.int64)] = True
    for b, tree in enumerate(forest.trees):
        at = np.arange(x.shape[0]) if member is None else np.flatnonzero(member[:, b])
        if not at.size:
            continue
        values = get(b)[tree.route(x[at])]
        if what == "survival":  # running log of the sum of exp(-H)
            if total is None:
                total = np.full((x.shape[0], values.shape[1]), -np.inf)
            total[at] = np.logaddexp(total[at], -values)
        else:
            if total is None:
                total = np.zeros((x.shape[0], values.shape[1]))
            total[at] += values
        used[at] += 1
    width = 1 if total is None else total.shape[1]
    if total is None:
        return np.full((x.shape[0], width), np.nan), used
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -(total - np.log(used)[:, None]) if what == "survival" else total / used[:, None]
    out[used == 0] = np.nan
    if what == "cif_hazard":
        grid = forest.event_times
        steps = np.nan_to_num(out).reshape(x.shape[0], forest.n_causes, grid.size)
        done = incidence(steps, grid, times).reshape(x.shape[0], -1)
        done[used == 0] = np.nan
        return done, used
    return out, used


def predict(df: DataFrame, forest, features: list[str], keep: list[str], what: str, times: list[float], allowed: str | None = None) -> DataFrame:
    """``keep``, ``_value`` (an array) and ``n_trees`` per row; ``forest`` is a broadcast of :class:`ForestArrays`."""
    names = [*keep, *features, *([allowed] if allowed else [])]
    rows = df.select(*keep, *(F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)), *([allowed] if allowed else []))
    out = T.StructType([*rows.select(*keep).schema, T.StructField("_value", T.ArrayType(T.DoubleType())), T.StructField("n_trees", T.IntegerType())])
    at = np.asarray(times, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))]) if batch.num_rows else np.zeros((0, len(features)))
            trees = batch.column(len(names) - 1).to_pylist() if allowed else None
            values, used = average(forest.value, x, what, at, trees)
            flat = pa.array(values.ravel())
            offsets = pa.array(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists, pa.array(used.astype(np.int32))], names=[f.name for f in out])

    return rows.mapInArrow(run, out)


def leaves_of(df: DataFrame, forest, features: list[str], keep: list[str]) -> DataFrame:
    """``keep``, ``tree``, ``leaf`` of every row and tree."""
    rows = df.select(*keep, *(F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)))
    out = T.StructType([*rows.select(*keep).schema, T.StructField("_leaves", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            table = np.stack([t.route(x) for t in forest.value.trees], axis=1).astype(np.int32)
            offsets = pa.array(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], names=[f.name for f in out])

    return rows.mapInArrow(run, out).select(*keep, F.posexplode("_leaves").alias("tree", "leaf"))
