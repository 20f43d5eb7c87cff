"""Two-group log-rank tests under left truncation, and the best split of one node.

With ``y, d`` at risk and events at an event time and ``yl, dl`` those of the left
group, ``U = sum(dl - d yl / y)`` and ``V = sum d (yl/y) (1 - yl/y) (y-d)/(y-1)``
over times with at least two at risk; the statistic is ``U^2 / V`` (0 if V is 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.frame import CountingProcess
from hazardframe.operators.estimators import at_risk_table
from hazardframe.operators.reshape import bin_columns


def _terms(rows: DataFrame, by: list[str], causes: int | None) -> DataFrame:
    """``u`` and ``v`` per ``by`` (and ``cause``, if given) from counts of all and of the left."""
    if causes is None:
        per = rows.select(*by, "y", "y_left", "d", F.col("d_left").alias("dl"))
        group = by
    else:
        each = F.array(*(F.struct(F.lit(j).cast("long").alias("cause"), F.col(f"d{j}").alias("d"), F.col(f"d_left{j}").alias("dl")) for j in range(1, causes + 1)))
        per = rows.select(*by, "y", "y_left", F.explode(each).alias("c")).select(*by, "y", "y_left", "c.*")
        group = [*by, "cause"]
    share = F.col("y_left") / F.col("y")
    u = F.col("dl") - F.col("d") * share
    v = F.col("d") * share * (1 - share) * (F.col("y") - F.col("d")) / (F.col("y") - 1)
    return per.where("y >= 2 and d > 0").groupBy(*group).agg(F.sum(u).alias("u"), F.sum(v).alias("v"))


def _chi2() -> Column:
    return F.when(F.col("v") > 0, F.col("u") * F.col("u") / F.col("v")).otherwise(0.0)


def _counts(cp: CountingProcess, candidates: DataFrame, left: Column, by: list[str], causes: list[int] | None) -> DataFrame:
    """Risk-set counts of each candidate; ``candidates`` is a small table that says which rows go left."""
    rows = cp.df.crossJoin(F.broadcast(candidates)).withColumn("_left", F.coalesce(left, F.lit(False)))  # few candidates
    marks = {"left": F.col("_left")}
    if causes is None:
        return at_risk_table(cp.with_df(rows), by, None, marks)
    # events of a cause on the left: a mark of its own per cause
    per_cause = {f"left{j}": F.col("_left") & (F.col(cp.event) == c) for j, c in enumerate(causes, 1)}
    return at_risk_table(cp.with_df(rows), by, causes, marks | per_cause)


def logrank_thresholds(cp: CountingProcess, feature: str, thresholds: list[float]) -> DataFrame:
    """``threshold, u, v, chi2`` of ``feature <= threshold`` against the rest, events of any cause."""
    candidates = cp.df.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    counts = _counts(cp, candidates, F.col(feature) <= F.col("threshold"), ["threshold"], None)
    return _terms(counts, ["threshold"], None).select("threshold", "u", "v", _chi2().alias("chi2"))


def logrank_by_cause(cp: CountingProcess, feature: str, thresholds: list[float], causes: list[int]) -> DataFrame:
    """``threshold, cause, chi2``: other causes leave as if censored."""
    candidates = cp.df.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    counts = _counts(cp, candidates, F.col(feature) <= F.col("threshold"), ["threshold"], causes)
    coded = F.element_at(F.array(*(F.lit(c).cast("long") for c in causes)), F.col("cause").cast("int"))
    return _terms(counts, ["threshold"], len(causes)).select("threshold", coded.alias("cause"), _chi2().alias("chi2"))


def composite_logrank(cp: CountingProcess, feature: str, thresholds: list[float], causes: list[int]) -> DataFrame:
    """``threshold, chi2``: the sum of the causes' statistics."""
    return logrank_by_cause(cp, feature, thresholds, causes).groupBy("threshold").agg(F.sum("chi2").alias("chi2"))


def split_candidates(cp: CountingProcess, edges: dict[str, list[float]], min_units: int, min_events: int, with_missing: bool = False) -> DataFrame:
    """Every admissible root split with its log-rank score.

    ``feature_no, feature, bin, threshold, missing`` (where missing values go:
    "right", "left", or "alone" against the observed), ``units_left``,
    ``units_right``, ``events_left``, ``events_right``, ``score``. A unit with rows
    on both sides counts on both.
    """
    spark = cp.df.sparkSession
    rows = []
    for no, (f, e) in enumerate(edges.items()):
        ways = ["right", "left"] if with_missing else ["right"]
        if with_missing:
            rows.append((no, f, -1, None, "alone"))
        rows += [(no, f, b, float(x), way) for b, x in enumerate(e) for way in ways]
    candidates = spark.createDataFrame(rows, "feature_no int, feature string, bin int, threshold double, missing string")
    key = ["feature_no", "feature", "bin", "threshold", "missing"]
    binned = bin_columns(cp.df, edges)
    value = F.lit(None).cast("int")
    for f in edges:
        value = F.when(F.col("feature") == f, F.col(f"{f}_bin")).otherwise(value)
    left = F.when(F.col("missing") == "alone", value.isNull()).when(value.isNull(), F.col("missing") == "left").otherwise(value <= F.col("bin"))
    wide = binned.crossJoin(F.broadcast(candidates)).withColumn("_left", left)  # few candidates
    events = (F.col(cp.event) != 0).cast("long")
    # per unit first, so that no distinct count is needed
    units = wide.groupBy(*key, cp.id).agg(F.max("_left").alias("l"), F.min("_left").alias("all_l"), F.sum(F.when(F.col("_left"), events).otherwise(0)).alias("el"), F.sum(events).alias("e"))
    sides = units.groupBy(*key).agg(
        F.sum(F.col("l").cast("long")).alias("units_left"),
        F.sum((~F.col("all_l")).cast("long")).alias("units_right"),
        F.sum("el").alias("events_left"),
        F.sum(F.col("e") - F.col("el")).alias("events_right"),
    )
    sides = sides.where((F.least("units_left", "units_right") >= min_units) & (F.least("events_left", "events_right") >= min_events))
    sides = sides.withColumn("candidate", F.struct(*key))
    counts = at_risk_table(cp.with_df(wide.withColumn("candidate", F.struct(*key))), ["candidate"], None, {"left": F.col("_left")})
    scores = _terms(counts, ["candidate"], None).select("candidate", _chi2().alias("score"))
    return sides.join(scores, "candidate").drop("candidate")


def best_split(cp: CountingProcess, edges: dict[str, list[float]], min_units: int = 15, min_events: int = 3, with_missing: bool = False) -> DataFrame:
    """The admissible candidate of the largest positive score; ties go to the first feature, then the least bin, then missing right."""
    found = split_candidates(cp, edges, min_units, min_events, with_missing).where("score > 0")
    way = F.when(F.col("missing") == "right", 0).when(F.col("missing") == "left", 1).otherwise(-1)
    return found.orderBy(F.desc("score"), "feature_no", "bin", way).limit(1)

