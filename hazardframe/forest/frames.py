"""Forests as DataFrames, and predictions as joins and windows over them.

``nodes(tree, node, feature, threshold, missing, left, right, leaf)`` with missing
values going ``right``, ``left`` or ``alone`` (against the observed),
``leaves(tree, leaf, t, cause, jump)`` with the hazard increments of each leaf,
``bags(tree, unit, copies)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.functions import hash31, hash_cell, numbered
from hazardframe.operators.estimators import product_limit

NODES = "tree int, node int, feature string, threshold double, missing string, left int, right int, leaf int"
LEAVES = "tree int, leaf int, t double, cause int, jump double"


def draw_bags(units: DataFrame, unit: str, n_trees: int, n_draw: int, seed: int, bootstrap: bool = False) -> DataFrame:
    """``tree, unit, copies``: the units of each tree's bag.

    Without replacement a bag holds the ``n_draw`` units of the least hash of
    (seed, tree, unit); with it, draw ``i`` takes the unit whose number (from 0,
    by hash of the seed and the unit) is a hash of (seed, tree, i). Bags depend on
    nothing else, so a lost task draws the same again.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    if not bootstrap:
        rows = units.select(F.col(unit), trees).withColumn("_h", hash31(F.lit(seed), F.col("tree"), F.col(unit)))
        rows = rows.withColumn("_cell", hash_cell(F.col("_h")))
        # the cell of hashes where a tree's bag is full; only its units are ordered
        upto = F.sum("_n").over(Window.partitionBy("tree").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        counts = rows.groupBy("tree", "_cell").agg(F.count("*").alias("_n")).withColumn("_upto", upto)
        last = counts.where((F.col("_upto") >= n_draw) & (F.col("_upto") - F.col("_n") < n_draw))
        last = last.select("tree", F.col("_cell").alias("_last"), (n_draw - F.col("_upto") + F.col("_n")).alias("_left"))
        dealt = rows.join(F.broadcast(last), "tree", "left")  # a row a tree; none for a bag of all units and more
        whole = dealt.where(F.col("_last").isNull() | (F.col("_cell") < F.col("_last")))
        place = F.row_number().over(Window.partitionBy("tree").orderBy("_h", unit))
        some = dealt.where(F.col("_cell") == F.col("_last")).withColumn("_r", place).where(F.col("_r") <= F.col("_left"))
        return whole.select("tree", unit).unionAll(some.select("tree", unit)).withColumn("copies", F.lit(1))
    total = units.count()
    h = hash31(F.lit(seed), F.col(unit))
    every = numbered(units.select(unit), "_n", [h, unit], hash_cell(h))
    draws = units.sparkSession.range(n_trees * n_draw).select((F.col("id") / n_draw).cast("int").alias("tree"), (F.col("id") % n_draw).alias("_i"))
    draws = draws.withColumn("_n", hash31(F.lit(seed + 1), F.col("tree"), F.col("_i")) % total)
    return draws.join(every, "_n").groupBy("tree", unit).agg(F.count("*").cast("int").alias("copies"))


def route_column(nodes: list, tree: int) -> Column:
    """The leaf of a row in one small tree, as a nested expression; missing values are tested first."""
    mine = {r.node: r for r in nodes if r.tree == tree}

    def at(n: int) -> Column:
        r = mine[n]
        if r.leaf is not None and r.leaf >= 0:
            return F.lit(r.leaf)
        x = F.col(r.feature)
        gone = x.isNull() | F.isnan(x)
        left = gone if r.missing == "alone" else F.when(gone, F.lit(r.missing == "left")).otherwise(x <= r.threshold)
        return F.when(left, at(r.left)).otherwise(at(r.right))

    return at(0)


def route(rows: DataFrame, nodes: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``tree``, ``leaf`` of every row and tree, for forests small enough to be an expression."""
    held = nodes.orderBy("tree", "node").collect()  # a model, not data
    trees = sorted({r.tree for r in held})
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), route_column(held, t).alias("leaf")) for t in trees)))
    return rows.select(*keep, pairs.alias("_p")).select(*keep, "_p.*")


def cumulative_hazard(routed: DataFrame, leaves: DataFrame, times: list[float], n_trees: int, key: list[str], by_cause: bool = False) -> DataFrame:
    """``key, (cause,) t, cumhaz``: the mean over trees of the leaves' cumulative hazards."""
    asked = F.array(*(F.lit(float(t)) for t in times))
    steps = leaves.withColumn("at", F.explode(F.filter(asked, lambda x: x >= F.col("t"))))
    steps = steps.groupBy("tree", "leaf", *(["cause"] if by_cause else []), "at").agg(F.sum("jump").alias("h"))
    joined = routed.join(steps, ["tree", "leaf"])
    group = [*key, *(["cause"] if by_cause else []), "at"]
    some = joined.groupBy(*group).agg((F.sum("h") / n_trees).alias("cumhaz"))
    base = routed.select(*key).distinct().withColumn("at", F.explode(asked))
    if by_cause:
        base = base.crossJoin(F.broadcast(leaves.select("cause").distinct()))  # few causes
    return base.join(some, group, "left").select(*key, *(["cause"] if by_cause else []), F.col("at").alias("t"), F.coalesce("cumhaz", F.lit(0.0)).alias("cumhaz"))


def mean_survival(routed: DataFrame, leaves: DataFrame, times: list[float], n_trees: int, key: list[str]) -> DataFrame:
    """``key, t, cumhaz``: minus the log of the mean over trees of ``exp(-H)``, without underflow."""
    asked = F.array(*(F.lit(float(t)) for t in times))
    steps = leaves.withColumn("at", F.explode(F.filter(asked, lambda x: x >= F.col("t")))).groupBy("tree", "leaf", "at").agg(F.sum("jump").alias("h"))
    every = routed.withColumn("at", F.explode(asked)).join(steps, ["tree", "leaf", "at"], "left").withColumn("x", -F.coalesce("h", F.lit(0.0)))
    top = F.max("x").over(Window.partitionBy(*key, "at"))
    return every.withColumn("m", top).groupBy(*key, F.col("at").alias("t"), "m").agg((-(F.col("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m"))) / n_trees))).alias("cumhaz")).drop("m")


def mortality(routed: DataFrame, leaves: DataFrame, times: list[float], n_trees: int, key: list[str]) -> DataFrame:
    """``key, mortality``: the sum of the cumulative hazard over ``times``; each jump counts once per time from it on."""
    later = F.size(F.filter(F.array(*(F.lit(float(t)) for t in times)), lambda x: x >= F.col("t")))
    weight = leaves.groupBy("tree", "leaf").agg(F.sum(F.col("jump") * later).alias("m"))
    return routed.join(weight, ["tree", "leaf"], "left").groupBy(*key).agg((F.coalesce(F.sum("m"), F.lit(0.0)) / n_trees).alias("mortality"))


def _wide(jumps: DataFrame, key: list[str], causes: int, scale: float = 1.0) -> DataFrame:
    return jumps.groupBy(*key, "t").agg(*((F.coalesce(F.sum(F.when(F.col("cause") == j, F.col("jump"))), F.lit(0.0)) / scale).alias(f"l{j}") for j in range(1, causes + 1)))


def _at_times(curves: DataFrame, key: list[str], keys: DataFrame, times: list[float], causes: int) -> DataFrame:
    """Last values of ``surv`` and ``f1``... at or before each time; 1 and 0 before the first."""
    names = ["surv", *(f"f{j}" for j in range(1, causes + 1))]
    asked = keys.withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in times)))).withColumns({"_side": F.lit(1), **{n: F.lit(None).cast("double") for n in names}})
    w = Window.partitionBy(*key).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = curves.select(*key, "t", F.lit(0).alias("_side"), *names).unionByName(asked.select(*key, "t", "_side", *names))
    both = both.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(w), F.lit(1.0 if n == "surv" else 0.0)) for n in names})
    return both.where("_side = 1").select(*key, "t", *names)


def cumulative_incidence(routed: DataFrame, leaves: DataFrame, times: list[float], n_trees: int, key: list[str], causes: int, aggregate: str = "cif") -> DataFrame:
    """``key, t, surv, f1``...: product limits per tree, then averaged (``cif``), or of averaged increments (``hazard``)."""
    jumps = routed.join(leaves, ["tree", "leaf"])
    if aggregate == "hazard":
        curves = product_limit(_wide(jumps, key, causes, n_trees), key, causes)
        return _at_times(curves, key, routed.select(*key).distinct(), times, causes)
    group = [*key, "tree"]
    curves = product_limit(_wide(jumps, group, causes), group, causes)
    every = _at_times(curves, group, routed.select(*group).distinct(), times, causes)
    return every.groupBy(*key, "t").agg(*((F.sum(c) / n_trees).alias(c) for c in ["surv", *(f"f{j}" for j in range(1, causes + 1))]))


def path_jumps(routed: DataFrame, leaves: DataFrame, origins: DataFrame, path: str = "id", locf: bool = False) -> DataFrame:
    """Jumps that the rows of a path meet: those of the row's leaf in ``(max(start, origin), stop]``.

    ``routed`` has ``path, start, stop, tree, leaf``; with ``locf`` a path's last row has no end.
    """
    rows = routed.join(origins, path)
    last = F.max("stop").over(Window.partitionBy(path, "tree"))
    end = F.when((F.col("stop") == last) & F.lit(locf), F.lit(float("inf"))).otherwise(F.col("stop"))
    rows = rows.withColumns({"_a": F.greatest("start", "origin"), "_z": end})
    return rows.join(leaves, ["tree", "leaf"]).where((F.col("t") > F.col("_a")) & (F.col("t") <= F.col("_z"))).select(path, "tree", "t", "cause", "jump")


def path_cumulative_hazard(routed: DataFrame, leaves: DataFrame, origins: DataFrame, times: list[float], n_trees: int, path: str = "id", locf: bool = False) -> DataFrame:
    """``path, t, cumhaz`` since the path's origin; null before it and, without ``locf``, past the last stop."""
    jumps = path_jumps(routed, leaves, origins, path, locf)
    asked = F.array(*(F.lit(float(t)) for t in times))
    sums = jumps.withColumn("at", F.explode(F.filter(asked, lambda x: x >= F.col("t")))).groupBy(path, "at").agg((F.sum("jump") / n_trees).alias("h"))
    span = routed.groupBy(path).agg(F.max("stop").alias("_end")).join(origins, path).withColumn("at", F.explode(asked))
    known = (F.col("at") >= F.col("origin")) & (F.lit(locf) | (F.col("at") <= F.col("_end")))
    out = span.join(sums, [path, "at"], "left")
    return out.select(path, F.col("at").alias("t"), F.when(known, F.coalesce("h", F.lit(0.0))).alias("cumhaz"))


def path_cumulative_incidence(routed: DataFrame, leaves: DataFrame, origins: DataFrame, times: list[float], n_trees: int, causes: int, path: str = "id", locf: bool = False, aggregate: str = "cif") -> DataFrame:
    """``path, t, surv, f1``... given survival to the origin; null where :func:`path_cumulative_hazard` is."""
    jumps = path_jumps(routed, leaves, origins, path, locf)
    group = [path] if aggregate == "hazard" else [path, "tree"]
    curves = product_limit(_wide(jumps, group, causes, n_trees if aggregate == "hazard" else 1.0), group, causes)
    every = _at_times(curves, group, routed.select(*group).distinct(), times, causes)
    names = ["surv", *(f"f{j}" for j in range(1, causes + 1))]
    if aggregate != "hazard":
        every = every.groupBy(path, "t").agg(*((F.sum(c) / n_trees).alias(c) for c in names))
    span = routed.groupBy(path).agg(F.max("stop").alias("_end")).join(origins, path)
    known = (F.col("t") >= F.col("origin")) & (F.lit(locf) | (F.col("t") <= F.col("_end")))
    return every.join(span, path).select(path, "t", *(F.when(known, F.col(c)).alias(c) for c in names))


def out_of_bag(required: DataFrame, bags: DataFrame, n_trees: int, key: list[str], unit: list[str]) -> DataFrame:
    """``key, tree``: the trees whose bag holds none of a row's required units (rows ``key`` + ``unit``)."""
    every = required.select(*key).distinct().withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    used = required.join(bags.select("tree", *unit), unit).select(*key, "tree").distinct()
    return every.join(used, [*key, "tree"], "left_anti")
