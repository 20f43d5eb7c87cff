"""Non-parametric estimators from risk-set sweeps.

The number at risk before each time is a running sum of entries less exits, so
risk sets cost one grouping by time (summed map-side) and one window over distinct
times, where the join of rows with times would be quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.frame import CountingProcess
from hazardframe.functions import running, running_sum


def _names(n: int) -> list[str]:
    return [f"d{j}" for j in range(1, n + 1)]


def at_risk_table(cp: CountingProcess, by: list[str] | None = None, causes: list[int] | None = None, marks: dict[str, Column] | None = None) -> DataFrame:
    """Per time of ``by``: ``y`` at risk, ``d`` events, ``c`` censored, ``d1``... events of each cause.

    ``marks`` are 0/1 columns; each adds ``y_<mark>`` and ``d_<mark>``, the counts
    of marked rows. Rows of all times are kept, those of entries too.
    """
    by, marks = list(by or []), marks or {}
    event, stop = F.col(cp.event), F.col(cp.stop)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    values = {"d": (event != 0).cast("long"), "c": (event == 0).cast("long")}
    values |= {f"d{j}": (event == c).cast("long") for j, c in enumerate(causes or [], 1)}
    values |= {f"d_{m}": (c.cast("boolean") & (event != 0)).cast("long") for m, c in marks.items()}
    flows = {"y": one} | {f"y_{m}": c.cast("long") for m, c in marks.items()}
    enter = F.struct(F.col(cp.start).cast("double").alias("t"), *(zero.alias(k) for k in values), *(v.alias(k) for k, v in flows.items()))
    leave = F.struct(stop.cast("double").alias("t"), *(v.alias(k) for k, v in values.items()), *((-v).alias(k) for k, v in flows.items()))
    points = cp.df.select(*by, F.explode(F.array(enter, leave)).alias("p")).select(*by, "p.*")
    summed = points.groupBy(*by, "t").agg(*(F.sum(k).alias(k) for k in (*values, *flows)))
    before = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return summed.select(*by, "t", *(F.coalesce(F.sum(k).over(before), zero).alias(k) for k in flows), *values)


def nelson_aalen(cp: CountingProcess, by: list[str] | None = None) -> DataFrame:
    """``t, y, d, cumhaz`` at the event times, of any cause."""
    by = list(by or [])
    return at_risk_table(cp, by).where("d > 0").select(*by, "t", "y", "d", F.sum(F.col("d") / F.col("y")).over(running(by, "t")).alias("cumhaz"))


def nelson_aalen_by_cause(cp: CountingProcess, causes: list[int], by: list[str] | None = None) -> DataFrame:
    """``t, y, d`` and ``h1``... per cause at the times of events of any cause."""
    by = list(by or [])
    w = running(by, "t")
    hazards = [F.sum(F.col(d) / F.col("y")).over(w).alias(f"h{j}") for j, d in enumerate(_names(len(causes)), 1)]
    return at_risk_table(cp, by, causes).where("d > 0").select(*by, "t", "y", "d", *hazards)


def kaplan_meier(cp: CountingProcess, by: list[str] | None = None) -> DataFrame:
    """``t, y, d, surv`` at the event times."""
    by = list(by or [])
    return at_risk_table(cp, by).where("d > 0").select(*by, "t", "y", "d", F.product(1 - F.col("d") / F.col("y")).over(running(by, "t")).alias("surv"))


def censoring_survival(cp: CountingProcess, by: list[str] | None = None) -> DataFrame:
    """Reverse Kaplan-Meier ``t, y, c, g``: events leave before the censored of the same time."""
    by = list(by or [])
    hazard = F.col("c") / (F.col("y") - F.col("d"))
    return at_risk_table(cp, by).where("c > 0").select(*by, "t", "y", "c", F.product(1 - hazard).over(running(by, "t")).alias("g"))


def product_limit(increments: DataFrame, by: list[str], causes: int) -> DataFrame:
    """Aalen-Johansen from hazard increments ``l1``...``lJ`` per time: adds ``surv`` and ``f1``...

    A step below zero is held at zero.
    """
    w = running(by, "t")
    total = sum((F.col(f"l{j}") for j in range(1, causes + 1)), F.lit(0.0))
    rows = increments.withColumn("surv", F.product(F.greatest(F.lit(0.0), 1 - total)).over(w))
    rows = rows.withColumn("_before", F.lag("surv", 1, 1.0).over(Window.partitionBy(*by).orderBy("t")))
    return rows.withColumns({f"f{j}": F.sum(F.col("_before") * F.col(f"l{j}")).over(w) for j in range(1, causes + 1)}).drop("_before")


def aalen_johansen(cp: CountingProcess, causes: list[int], by: list[str] | None = None) -> DataFrame:
    """``t, surv, f1``...: event-free probability and cumulative incidences at the event times."""
    by = list(by or [])
    rows = at_risk_table(cp, by, causes).where("d > 0")
    rows = rows.withColumns({f"l{j}": F.col(d) / F.col("y") for j, d in enumerate(_names(len(causes)), 1)})
    return product_limit(rows, by, len(causes)).select(*by, "t", "surv", *(f"f{j}" for j in range(1, len(causes) + 1)))


def step_lookup(asked: DataFrame, steps: DataFrame, value: str, default: float, by: list[str] | None = None, time: str = "t", left: bool = False) -> DataFrame:
    """The value of a right-continuous step function at each ``time`` of ``asked`` (``left``: just before it).

    Distinct times are looked up, by a union in time order that carries the last
    step, and joined back, so the window never holds more than distinct times.
    """
    by = list(by or [])
    times = asked.select(*by, F.col(time).alias("t")).distinct()
    first, second = (1, 0) if left else (0, 1)  # which side comes first at equal times
    both = steps.select(*by, "t", F.col(value).alias("_v"), F.lit(first).alias("_side")).unionByName(
        times.withColumns({"_v": F.lit(None).cast("double"), "_side": F.lit(second)})
    )
    w = Window.partitionBy(*by).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == second)
    found = found.select(*by, F.col("t").alias(time), F.coalesce("_v", F.lit(float(default))).alias(value))
    return asked.join(found, [*by, time])


def event_windows(cp: CountingProcess, n: int = 8) -> list[float]:
    """Edges ``0, ..., tau``: the times of the ``ceil(k D / n)``-th of the ``D`` events, without repeats; positive times."""
    return [0.0] + [r.t for r in event_window_table(cp, n).orderBy("t").collect()]


def event_window_table(cp: CountingProcess, n: int = 8) -> DataFrame:
    """The inner and last edges of :func:`event_windows` as ``t``."""
    times = cp.df.where(F.col(cp.event) != 0).groupBy(F.col(cp.stop).cast("double").alias("t")).agg(F.count("*").alias("d"))
    total = times.agg(F.sum("d").alias("total"))
    ranked = running_sum(times, "upto", "d", "t").crossJoin(F.broadcast(total))  # one row
    holds = F.expr(f"(upto * {n}) div total > ((upto - d) * {n}) div total")
    return ranked.where(holds & (F.col("t") > 0)).select("t")


def baseline_at(cp: CountingProcess, edges: list[float]) -> DataFrame:
    """Pooled cumulative hazard ``h0`` at the edges."""
    asked = cp.df.sparkSession.createDataFrame([(float(e),) for e in edges], "t double")
    return step_lookup(asked, nelson_aalen(cp), "cumhaz", 0.0).select("t", F.col("cumhaz").alias("h0"))


def survival_at(cp: CountingProcess, w: float, by: list[str]) -> DataFrame:
    """Kaplan-Meier ``P(T > w)`` per group as ``surv``, events at ``w`` included; 1 where none are."""
    table = at_risk_table(cp, by)
    factor = F.when((F.col("d") > 0) & (F.col("t") <= w), 1 - F.col("d") / F.col("y")).otherwise(1.0)
    return table.groupBy(*by).agg(F.product(factor).alias("surv"))


def calibration(cp: CountingProcess, risk: str, w: float, n_bins: int = 10) -> DataFrame:
    """``bin, n, n_events, mean_risk, observed_risk`` in quantile bins of ``risk``; bins are descriptive."""
    cuts = F.array(*(F.lit(i / n_bins) for i in range(n_bins + 1)))
    edges = cp.df.agg(F.array_distinct(F.percentile(risk, cuts)).alias("_edges"))
    place = F.size(F.filter("_edges", lambda e: e <= F.col(risk))) - 1
    binned = cp.df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(0), F.least(place, F.size("_edges") - 2)))  # one row of edges
    binned = binned.drop("_edges")
    hit = (F.col(cp.event) != 0) & (F.col(cp.stop) <= w)
    basic = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("n_events"), F.avg(risk).alias("mean_risk"))
    observed = survival_at(cp.with_df(binned), w, ["bin"])
    return basic.join(observed, "bin").select(F.col("bin").cast("long"), "n", "n_events", "mean_risk", (1 - F.col("surv")).alias("observed_risk"))

