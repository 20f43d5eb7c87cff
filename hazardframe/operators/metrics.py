"""Scores of predicted risks under censoring and competing risks.

Tables to score have ``stop``, ``event`` (0 or a cause), ``risk``, and a start of 0
for the landmark scores. ``by`` scores every group of a table in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.errors import UndefinedMetricError
from hazardframe.frame import CountingProcess
from hazardframe.functions import steps_below
from hazardframe.operators import pairs
from hazardframe.operators.estimators import censoring_survival, step_lookup


@dataclass(frozen=True)
class Score:
    value: float
    info: dict


def outcome_classes(w, cause: int | None = None) -> tuple[Column, Column, Column]:
    """(case, competing, control) at horizon ``w``; without a cause any event makes a case."""
    by_w = (F.col("event") != 0) & (F.col("stop") <= w)
    case = by_w if cause is None else by_w & (F.col("event") == cause)
    competing = F.lit(False) if cause is None else by_w & (F.col("event") != cause)
    return case, competing, (F.col("stop") >= w) & ~by_w


def ipcw(df: DataFrame, w, cause: int | None = None, censor: DataFrame | None = None, g_min: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Adds ``case, competing, control, weight, clipped``.

    Weights are ``1/G(stop-)`` for events by ``w``, ``1/G(w-)`` for those free of
    events through ``w`` and 0 for those censored before it, ``G`` being the
    censoring survival of ``censor`` (the table itself by default) held above
    ``g_min``. Where nobody is censored before ``w`` all weights are 1.
    """
    by = list(by or [])
    if not 0 < g_min <= 1:
        raise ValueError("g_min must lie in (0, 1]")
    w = w if isinstance(w, Column) else F.lit(float(w))
    case, competing, control = outcome_classes(w, cause)
    rows = df.withColumns({"case": case, "competing": competing, "control": control})
    seen = F.col("case") | F.col("competing")
    rows = rows.withColumn("_at", F.when(seen, F.col("stop")).otherwise(w))
    source = censor if censor is not None else df
    g = censoring_survival(CountingProcess(source.withColumn("start", F.lit(0.0)).withColumn("id", F.lit(0)) if "id" not in source.columns else source.withColumn("start", F.lit(0.0))), by)
    rows = step_lookup(rows, g, "g", 1.0, by, "_at", left=True)
    used = seen | F.col("control")
    exact = rows.groupBy(*by).agg(F.min((F.col("case") | F.col("competing") | F.col("control")).cast("int")).alias("_exact"))
    rows = rows.join(F.broadcast(exact), by) if by else rows.crossJoin(F.broadcast(exact))  # one row a group
    weight = F.when(F.col("_exact") == 1, 1.0).when(used, 1 / F.greatest(F.col("g"), F.lit(g_min))).otherwise(0.0)
    clipped = (F.col("_exact") == 0) & used & (F.col("g") < g_min)
    return rows.withColumns({"weight": weight, "clipped": clipped}).drop("_at", "_exact", "g")


def brier(df: DataFrame, w, cause: int | None = None, censor: DataFrame | None = None, g_min: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """``brier, n, n_cases, n_competing, n_controls, n_censored, n_clipped`` (per group)."""
    weighted = ipcw(df, w, cause, censor, g_min, by)
    count = lambda c: F.sum(c.cast("long"))
    off = F.col("case").cast("double") - F.col("risk")
    return weighted.groupBy(*(by or [])).agg(
        F.avg(F.col("weight") * off * off).alias("brier"),
        F.count("*").alias("n"),
        count(F.col("case")).alias("n_cases"),
        count(F.col("competing")).alias("n_competing"),
        count(F.col("control")).alias("n_controls"),
        count(~(F.col("case") | F.col("competing") | F.col("control"))).alias("n_censored"),
        count(F.col("clipped")).alias("n_clipped"),
    )


def integrated_brier(df: DataFrame, curve: str, times: list[float], cause: int | None = None, censor: DataFrame | None = None, g_min: float = 0.05) -> DataFrame:
    """``ibs``: the Brier scores of ``curve`` (an array over ``times``) by the trapezoid rule, over the range.

    Curves are survival probabilities, or with a cause its cumulative incidence.
    All times are scored in one plan.
    """
    if len(times) < 2 or any(b <= a for a, b in zip(times, times[1:], strict=False)) or times[0] <= 0:
        raise ValueError("times must be at least two increasing positive values")
    opened = df.select("*", F.posexplode(F.col(curve)).alias("_k", "_v"))
    opened = opened.withColumns({"_t": F.element_at(F.array(*(F.lit(float(t)) for t in times)), F.col("_k") + 1), "risk": F.col("_v") if cause is not None else 1 - F.col("_v")})
    source = (censor if censor is not None else df).withColumn("_t", F.explode(F.array(*(F.lit(float(t)) for t in times))))
    scores = brier(opened, F.col("_t"), cause, source, g_min, ["_t"])
    w = Window.orderBy("_t")  # one row a time
    step = (F.col("_t") - F.lag("_t").over(w)) * (F.col("brier") + F.lag("brier").over(w)) / 2
    return scores.withColumn("_s", step).agg((F.sum("_s") / F.lit(float(times[-1] - times[0]))).alias("ibs"))


def running_by_value(df: DataFrame, value: str, sums: list[str], buckets: int = 64) -> DataFrame:
    """Adds ``below_<sum>`` (over smaller values) and ``upto_<sum>``, one row per distinct value.

    Values are dealt into ranges at approximate quantiles, summed in each, and the
    ranges' totals added, so that no task orders all values.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(df.agg(F.percentile_approx(value, cuts, 1000).alias("e")).first().e or []))
    per = df.groupBy(value).agg(*(F.sum(s).alias(s) for s in sums))
    per = per.withColumn("_bucket", steps_below(edges, F.col(value)) if edges else F.lit(0))
    totals = per.groupBy("_bucket").agg(*(F.sum(s).alias(f"_{s}") for s in sums))  # a row a bucket
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", *(F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums))
    w = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(totals), "_bucket")
    for s in sums:
        out = out.withColumn(f"upto_{s}", F.sum(s).over(w) + F.col(f"_{s}")).withColumn(f"below_{s}", F.col(f"upto_{s}") - F.col(s))
    return out.drop("_bucket", *(f"_{s}" for s in sums))


def auc_cumulative(df: DataFrame, w: float, cause: int | None = None, censor: DataFrame | None = None, g_min: float = 0.05) -> DataFrame:
    """``auc``: cases by ``w`` against those without an event of the cause by then, pairs weighted by both weights.

    Null if there is no case or no control.
    """
    rows = ipcw(df, w, cause, censor, g_min)
    zero = F.lit(0.0)
    rows = rows.select("risk", F.when(F.col("case"), F.col("weight")).otherwise(zero).alias("a"), F.when(F.col("control") | F.col("competing"), F.col("weight")).otherwise(zero).alias("b"))
    per = running_by_value(rows, "risk", ["a", "b"])
    num = F.sum(F.col("a") * (F.col("below_b") + F.col("b") / 2))
    return per.agg(F.try_divide(num, F.sum("a") * F.sum("b")).alias("auc"))


def _negative(table: DataFrame) -> DataFrame:
    return table.select((-F.col("num")).alias("num"), (-F.col("den")).alias("den"))


def _at_risk_pairs(df: DataFrame, is_case: Column, weight: Column, group: Column, ranges: int) -> list[DataFrame]:
    """Cases against rows at risk at the case's time, but rows with any event then and rows of its group.

    Those at risk are those that entered before less those that left before.
    """
    one = F.lit(1.0).alias("w")
    cases = df.where(is_case).select(F.col("stop").alias("t"), F.col("risk").alias("r"), weight.alias("w"), group.alias("g"))
    entered = df.select(F.col("start").alias("t"), F.col("risk").alias("r"), one)
    left = df.select(F.col("stop").alias("t"), F.col("risk").alias("r"), one)
    ended = df.where("event != 0").select(F.col("stop").alias("t"), F.col("risk").alias("r"), one)
    rows = df.select(F.col("start").alias("a"), F.col("stop").alias("z"), (F.col("event") != 0).alias("e"), F.col("risk").alias("r2"), F.lit(1.0).alias("w2"), group.alias("g2"))
    own = pairs.own_group_pairs(cases, rows, lambda c, o: (o.a < c.t) & (c.t <= o.z) & ~(o.e & (o.z == c.t)))
    return [
        pairs.earlier_pairs(cases, entered, ranges=ranges),
        _negative(pairs.earlier_pairs(cases, left, ranges=ranges)),
        _negative(pairs.equal_time_pairs(cases, ended)),
        _negative(own),
    ]


def _competing_pairs(df: DataFrame, is_case: Column, cause: int, weight: Column, group: Column, ranges: int) -> list[DataFrame]:
    """Cases against rows of other groups with another cause's event no later."""
    cases = df.where(is_case).select(F.col("stop").alias("t"), F.col("risk").alias("r"), weight.alias("w"), group.alias("g"))
    rivals = df.where((F.col("event") != 0) & (F.col("event") != cause))
    earlier = rivals.select(F.col("stop").alias("t"), F.col("risk").alias("r"), weight.alias("w"))
    rows = rivals.select(F.col("stop").alias("z"), F.col("risk").alias("r2"), weight.alias("w2"), group.alias("g2"))
    own = pairs.own_group_pairs(cases, rows, lambda c, o: o.z <= c.t)
    return [pairs.earlier_pairs(cases, earlier, inclusive=True, ranges=ranges), _negative(own)]


def _share(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    sums = both.agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    # differences of sums of weights: what is left of an empty one is rounding
    den = F.when(F.col("den") > 1e-9, F.col("den"))
    return sums.select((F.col("num") / den).alias("concordance"), F.coalesce(den, F.lit(0.0)).alias("pairs"))


def concordance(df: DataFrame, id: str = "id", ranges: int | None = None) -> DataFrame:
    """``concordance, pairs``: each event against rows at risk at its time, of other ids and without an event then.

    Risk ties count one half; null without pairs. No pairs are made: see
    :mod:`hazardframe.operators.pairs`, whose number of ``ranges`` follows the rows.
    """
    return _share(_at_risk_pairs(df, F.col("event") != 0, F.lit(1.0), F.col(id), ranges or pairs.ranges_for(df)))


def concordance_competing(df: DataFrame, cause: int, id: str = "id", ranges: int | None = None) -> DataFrame:
    """As :func:`concordance` for events of ``cause``, and against other causes' events no later."""
    case, one, group = F.col("event") == cause, F.lit(1.0), F.col(id)
    ranges = ranges or pairs.ranges_for(df)
    return _share(_at_risk_pairs(df, case, one, group, ranges) + _competing_pairs(df, case, cause, one, group, ranges))


def cindex_incident(df: DataFrame, w: float, cause: int | None = None, censor: DataFrame | None = None, g_min: float = 0.05, ranges: int | None = None) -> DataFrame:
    """Concordance of events by ``w`` weighted by squared censoring weights; competing events weigh by both weights."""
    rows = ipcw(df.withColumn("start", F.lit(0.0)), w, cause, censor, g_min).withColumn("_row", F.lit(None).cast("long"))
    case, weight, none = F.col("case"), F.col("weight"), F.col("_row")  # rows are subjects: no group to leave out
    ranges = ranges or pairs.ranges_for(df)
    parts = _at_risk_pairs(rows, case, weight * weight, none, ranges)
    if cause is not None:
        parts += _competing_pairs(rows, case, cause, weight, none, ranges)
    return _share(parts)


def defined(table: DataFrame, column: str) -> float:
    """The single value of a metric; raises if it is not determined."""
    value = table.first()[column]
    if value is None:
        raise UndefinedMetricError(f"{column} has no pairs to compare")
    return float(value)


def piecewise_exponential(df: DataFrame, windows: list[float], curves: list[str], null: list[list[float]], causes: list[int] | None = None, alpha: float = 0.01, by: str = "total", id: str = "id") -> DataFrame:
    """Log-likelihood of window-wise constant rates: the sum of ``N log rate - rate * exposure``.

    ``curves`` are array columns with the cumulative hazard of each cause at the
    edges, ``null`` the same for the pooled baseline; rates mix in a share
    ``alpha`` of it. Rows are opened into the windows and causes they meet, once;
    the result is grouped by ``total``, ``window``, ``cause`` or ``id``:
    ``score, null_score, n_events, n_zero_rate, exposure``. Events outside of the
    windows are not scored; an event at rate 0 scores minus infinity.
    """
    causes = causes or [None]
    cells = []
    for m, (lo, hi) in enumerate(zip(windows, windows[1:], strict=False)):
        e = F.greatest(F.lit(0.0), F.least(F.col("stop"), F.lit(float(hi))) - F.greatest(F.col("start"), F.lit(float(lo))))
        inside = (F.col("stop") > lo) & (F.col("stop") <= hi)
        for j, (curve, cause) in enumerate(zip(curves, causes, strict=True)):
            label = (F.col("event") != 0) if cause is None else (F.col("event") == cause)
            d = F.element_at(curve, m + 2) - F.element_at(curve, m + 1)
            d0 = float(null[j][m + 1] - null[j][m])
            width = float(hi - lo)
            rate = ((1.0 - alpha) * d + alpha * d0) / width
            cells.append(F.struct(F.lit(m).alias("window"), F.lit(j + 1).alias("cause"), e.alias("e"), (inside & label).alias("hit"), rate.alias("rate"), (d <= 0).alias("zero"), F.lit(d0 / width).alias("rate0")))
    opened = df.select(F.col(id).alias("id"), F.explode(F.filter(F.array(*cells), lambda c: (c.e > 0) | c.hit)).alias("c")).select("id", "c.*")
    log = lambda x: F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))
    hit = F.col("hit").cast("long")
    score = F.when(F.col("hit"), log(F.col("rate"))).otherwise(0.0) - F.col("rate") * F.col("e")
    null_score = F.when(F.col("hit"), log(F.col("rate0"))).otherwise(0.0) - F.col("rate0") * F.col("e")
    key = {"total": [], "window": ["window"], "cause": ["cause"], "id": ["id"]}[by]
    return opened.groupBy(*key).agg(
        F.sum(score).alias("score"),
        F.sum(null_score).alias("null_score"),
        F.sum(hit).alias("n_events"),
        F.sum((F.col("hit") & F.col("zero")).cast("long")).alias("n_zero_rate"),
        F.sum("e").alias("exposure"),
    )
