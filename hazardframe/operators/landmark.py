"""Landmark stacks: what is known at times ``s`` about who is still at risk, and the outcome within a horizon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.errors import ValidationError
from hazardframe.frame import CountingProcess

#: Aggregations of a feature's known rows: (value, start, clock) to a column.
AGGREGATIONS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "last": lambda x, start, clock: F.max_by(x, start),
    "first": lambda x, start, clock: F.min_by(x, start),
    "mean": lambda x, start, clock: F.avg(x),
    "min": lambda x, start, clock: F.min(x),
    "max": lambda x, start, clock: F.max(x),
    "sum": lambda x, start, clock: F.coalesce(F.sum(x), F.lit(0.0)),
    "count": lambda x, start, clock: F.count("*").cast("double"),
    "slope": lambda x, start, clock: F.when(F.countDistinct(F.when(x.isNotNull(), clock)) < 2, None).otherwise(F.regr_slope(x, clock)),
    "std": lambda x, start, clock: F.stddev_samp(x),
}


def feature_names(specs: list) -> dict[str, tuple[str, str]]:
    """Name of each history feature to its column and aggregation: ``col`` (the last value) or ``(col, agg)``."""
    out: dict[str, tuple[str, str]] = {}
    for s in specs:
        column, agg = (s, "last") if isinstance(s, str) else s
        name = column if isinstance(s, str) else f"{column}_{agg}"
        if agg not in AGGREGATIONS:
            raise ValidationError(f"unknown aggregation {agg!r}")
        if name in out or name == "landmark":
            raise ValidationError(f"feature {name!r} is reserved or given twice")
        out[name] = (column, agg)
    return out


def landmark_times(cp: CountingProcess, landmarks: list[float] | None = None, step: float | None = None) -> list[float]:
    """The given times in order without repeats, or every ``step`` from the first entry to the last exit."""
    if (landmarks is None) == (step is None):
        raise ValueError("give exactly one of landmarks and step")
    if landmarks is not None:
        return sorted({float(s) for s in landmarks})
    low, high = cp.df.agg(F.min(cp.start), F.max(cp.stop)).first()
    count = 0
    out = []
    while low + count * step < high:
        out.append(float(low + count * step))
        count += 1
    return out


def _known(cp: CountingProcess, times: list[float], specs: list, at_exit: bool) -> DataFrame:
    """One row per id and landmark of its risk set, with the history features.

    The id's span is a window by id and rows are opened into the landmarks that see
    them, so the grouping by id and landmark reuses the one shuffle by id.
    """
    names = feature_names(specs)
    outcome = {cp.id, cp.stop, cp.event} | ({cp.measured_at} if cp.measured_at else set())
    if bad := sorted({c for c, _ in names.values()} & outcome):
        raise ValidationError(f"{bad} cannot be history features")
    whole = Window.partitionBy(cp.id)
    rows = cp.df.withColumns({"_entry": F.min(cp.start).over(whole), "_end": F.max(cp.stop).over(whole), "_label": F.max(cp.event).over(whole)})
    below = (lambda s: s <= F.col("_end")) if at_exit else (lambda s: s < F.col("_end"))
    seen = F.filter(F.array(*(F.lit(float(s)) for s in times)), lambda s: (s >= F.col(cp.start)) & below(s))
    rows = rows.withColumn("landmark", F.explode(seen))
    clock = F.col(cp.measured_at or cp.start)
    values = [AGGREGATIONS[agg](F.col(c).cast("double"), F.col(cp.start), clock).alias(n) for n, (c, agg) in names.items()]
    return rows.groupBy(cp.id, "landmark", "_entry", "_end", "_label").agg(*values)


def landmark_stack(cp: CountingProcess, horizon: float, specs: list, landmarks: list[float] | None = None, step: float | None = None) -> DataFrame:
    """``id, landmark, start, stop, event`` and features: risk sets ``entry <= s < exit`` on the reset clock.

    Follow-up is cut, censored, at ``horizon``. A row is known at ``s`` if it began by then.
    """
    known = _known(cp, landmark_times(cp, landmarks, step), specs, at_exit=False)
    end, s = F.col("_end"), F.col("landmark")
    event = F.when(end <= s + horizon, F.col("_label")).otherwise(0).cast("long")
    return known.select(F.col(cp.id).alias("id"), "landmark", F.lit(0.0).alias("start"), (F.least(end, s + horizon) - s).alias("stop"), event.alias("event"), *feature_names(specs))


def landmark_features(cp: CountingProcess, s: float, specs: list) -> DataFrame:
    """``id, landmark`` and features of those to predict for: ``entry <= s <= exit`` without an event by ``s``."""
    known = _known(cp, [s], specs, at_exit=True).where(~((F.col("_end") <= s) & (F.col("_label") != 0)))
    return known.select(F.col(cp.id).alias("id"), "landmark", *feature_names(specs))
