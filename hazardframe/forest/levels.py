"""Splitting nodes that hold more rows than a task should, level by level for all trees at once.

Spark sums, for every such node and each of its drawn features, the entries, exits
and events by bin and time, and the units by their least and greatest bin; what
reaches a task is the size of a histogram, whatever the number of rows. A task per
node turns it into the tables that the kernel scores. Nodes below the bound are
left to the kernel, each grown to its end from its rows.

Nodes are named by their path: the root is 1, the children of ``n`` are ``2 n`` and
``2 n + 1``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.forest import kernel
from hazardframe.storage import cut

#: Paths are longs; deeper nodes are left to the kernel at any size.
DEEPEST = 60

SPLIT = "tree int, path long, feature int, bin int, missing int, leaf_k int, cause int, value double"


def drawn_features(seed: int, tree: int, path: int, p: int, m: int) -> list[int]:
    return np.random.default_rng([seed, tree, path]).permutation(p)[:m].tolist()


def _sizes(rows: DataFrame) -> list:
    return rows.groupBy("tree", "path").agg(F.count("*").alias("n")).collect()  # a row a node, not a row a row


def split_level(rows: DataFrame, big: list[tuple[int, int]], limits: kernel.Limits, seed: int, p: int) -> DataFrame:
    """The split of each node in ``big``, or the jumps of its leaf (``leaf_k`` not null)."""
    spark = rows.sparkSession
    drawn = [(t, n, drawn_features(seed, t, n, p, limits.max_features or p)) for t, n in big]
    chosen = spark.createDataFrame(drawn, "tree int, path long, features array<int>")
    mine = rows.join(F.broadcast(chosen), ["tree", "path"])
    opened = mine.select("tree", "path", "unit", "copy", "a", "b", "cause", F.explode("features").alias("feature"), "bins").withColumn("bin", F.element_at("bins", F.col("feature") + 1).cast("int"))
    points = F.array(
        F.struct(F.col("a").alias("k"), F.lit(0).alias("cause"), F.lit(1).cast("long").alias("n")),
        F.struct(F.col("b").alias("k"), F.lit(0).alias("cause"), F.lit(-1).cast("long").alias("n")),
        F.struct((F.col("b") - 1).alias("k"), F.col("cause"), F.when(F.col("cause") > 0, 1).otherwise(0).cast("long").alias("n")),
    )
    flows = opened.select("tree", "path", "feature", "bin", F.explode(points).alias("q")).select("tree", "path", "feature", "bin", "q.*").where("n != 0")
    flows = flows.groupBy("tree", "path", "feature", "bin", "k", "cause").agg(F.sum("n").alias("n"))
    seen = F.when(F.col("bin") >= 0, F.col("bin"))
    sides = opened.groupBy("tree", "path", "feature", "unit", "copy").agg(F.min(seen).alias("low"), F.max(seen).alias("high"), F.max((F.col("bin") < 0).cast("int")).alias("gone"))
    sides = sides.groupBy("tree", "path", "feature", "low", "high", "gone").agg(F.count("*").alias("n"))
    # both sides come from the same rows, so one takes names of its own
    sides = sides.select(F.col("tree").alias("tree_"), F.col("path").alias("path_"), F.col("feature").alias("feature_"), "low", "high", "gone", F.col("n").alias("n_"))

    def split(flow: pa.Table, side: pa.Table) -> pa.Table:
        tree, path = flow.column("tree")[0].as_py(), flow.column("path")[0].as_py()
        f = {c: flow.column(c).to_numpy() for c in ("feature", "bin", "k", "cause", "n")}
        u = {c.rstrip("_"): side.column(c).to_numpy(zero_copy_only=False) for c in ("feature_", "low", "high", "gone", "n_")}
        features = drawn_features(seed, tree, path, p, limits.max_features or p)
        one = f["feature"] == features[0]
        hit = one & (f["cause"] > 0)
        times = np.unique(f["k"][hit])
        events = np.zeros((limits.causes, times.size))
        np.add.at(events, (f["cause"][hit] - 1, np.searchsorted(times, f["k"][hit])), f["n"][hit])
        at_risk = _risk(f, one & (f["cause"] == 0), times)
        units = int(u["n"][u["feature"] == features[0]].sum())
        found = None
        if kernel.divisible(units, events.sum(axis=1), path.bit_length() - 1, limits) and times.size:
            found = kernel.best_of((t for x in features if (t := _table(f, u, x, times, limits)) is not None), at_risk, events, limits)
        if found:
            out = [(tree, path, found[0], found[1], found[2], None, None, found[3])]
        else:
            out = [(tree, path, None, None, None, -1, j + 1, float(events[j].sum())) for j in range(limits.causes)]
            out += [(tree, path, None, None, None, int(times[k]), j + 1, float(events[j, k] / at_risk[k])) for j in range(limits.causes) for k in np.flatnonzero(events[j])]
        kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["tree", "path", "feature", "bin", "missing", "leaf_k", "cause", "value"])

    return flows.groupBy("tree", "path").cogroup(sides.groupBy("tree_", "path_")).applyInArrow(split, SPLIT)


def _risk(f: dict, use: np.ndarray, times: np.ndarray) -> np.ndarray:
    """At risk at ``times`` from net entries by grid time; an exit at ``b`` ends the risk before it."""
    net = np.bincount(np.searchsorted(times, f["k"][use]), weights=f["n"][use], minlength=times.size + 1)
    return np.cumsum(net)[: times.size]


def _table(f: dict, u: dict, feature: int, times: np.ndarray, limits: kernel.Limits) -> kernel.FeatureTable | None:
    mine, k = f["feature"] == feature, times.size
    seen = mine & (f["bin"] >= 0)
    n_bins = int(f["bin"][mine].max(initial=-1)) + 1
    if n_bins < 1:
        return None
    flow, hit = seen & (f["cause"] == 0), seen & (f["cause"] > 0)
    width = k + 1
    net = np.bincount(f["bin"][flow] * width + np.searchsorted(times, f["k"][flow]), weights=f["n"][flow], minlength=n_bins * width)
    left_risk = np.cumsum(np.cumsum(net.reshape(n_bins, width)[:, :k], axis=1), axis=0)
    left_events = np.zeros((limits.causes, n_bins, k))
    np.add.at(left_events, (f["cause"][hit] - 1, f["bin"][hit], np.searchsorted(times, f["k"][hit])), f["n"][hit])
    left_events = np.cumsum(left_events, axis=1)
    own = u["feature"] == feature
    low, high, gone, n = u["low"][own], u["high"][own], u["gone"][own] > 0, u["n"][own]
    some = ~np.isnan(low)
    # every bin with rows is the least or the greatest of a unit, or lies between; rows tell which are used
    used = np.unique(f["bin"][flow])[:-1]

    def counts(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.cumsum(np.bincount(a + 1, weights=n, minlength=n_bins + 2))
        beyond = n.sum() - np.cumsum(np.bincount(z + 1, weights=n, minlength=n_bins + 2))
        return upto[1:-1], beyond[1:-1]

    at = lambda x, none: np.where(some, np.nan_to_num(x), none).astype(np.int64)
    right = counts(at(low, n_bins), np.where(gone, n_bins, at(high, n_bins)))
    if not gone.any():
        return kernel.FeatureTable(feature, used, left_risk, left_events, [right])
    left = counts(np.where(gone, -1, at(low, -1)), at(high, -1))
    lost = mine & (f["bin"] < 0)
    lost_events = np.zeros((limits.causes, k))
    dead = lost & (f["cause"] > 0)
    np.add.at(lost_events, (f["cause"][dead] - 1, np.searchsorted(times, f["k"][dead])), f["n"][dead])
    return kernel.FeatureTable(feature, used, left_risk, left_events, [right, left], (_risk(f, lost & (f["cause"] == 0), times), lost_events, int(n[gone].sum()), int(n[some].sum())))


def descend(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of split nodes at their children; rows of others fall away."""
    cut = splits.where("feature is not null").select("tree", "path", "feature", "bin", "missing").withColumnRenamed("bin", "cut")
    both = rows.join(F.broadcast(cut), ["tree", "path"])  # a row a node
    x = F.element_at("bins", F.col("feature") + 1).cast("int")
    left = F.when(F.col("missing") == kernel.ALONE, x < 0).when(x < 0, F.col("missing") == kernel.LEFT).otherwise(x <= F.col("cut"))
    return both.withColumn("path", F.col("path") * 2 + F.when(left, 0).otherwise(1)).select(*rows.columns)


def split_large_nodes(rows: DataFrame, limits: kernel.Limits, seed: int, p: int, max_rows: int) -> tuple[list, DataFrame]:
    """(rows of :data:`SPLIT` of the nodes split here, rows with the path of the small node each has reached)."""
    rows = cut(rows.withColumn("path", F.lit(1).cast("long")))
    done: list = []
    small: DataFrame | None = None
    while True:
        big = [(r.tree, r.path) for r in _sizes(rows) if r.n > max_rows and r.path.bit_length() <= DEEPEST]
        if not big:
            return done, rows if small is None else small.unionByName(rows)
        table = rows.sparkSession.createDataFrame(big, "tree int, path long")
        rest = rows.join(F.broadcast(table), ["tree", "path"], "left_anti")
        small = rest if small is None else small.unionByName(rest)
        level = split_level(rows, big, limits, seed, p).collect()
        done += level
        # each level reads what the one before has written, so plans stay short
        rows = cut(descend(rows, rows.sparkSession.createDataFrame(level, SPLIT)))
