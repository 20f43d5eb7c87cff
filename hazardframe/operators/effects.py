"""Effects of a feature on predicted hazards and risks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.errors import ValidationError
from hazardframe.frame import CountingProcess
from hazardframe.operators.reshape import exposures
from hazardframe.sources.adapters import split_at_time


def hazard_effect(cp: CountingProcess, feature: str, values: list[float], windows: list[float], predict: Callable[[DataFrame, list[str]], DataFrame], individual: bool = False) -> DataFrame:
    """``value, m, hazard, supported``: the exposure-weighted hazard in each window if ``feature`` were ``value``.

    ``predict(rows, key)`` returns ``key, t, cumhaz`` at the windows' edges. A value
    is supported between the 5% and 95% quantiles of the rows at risk in the
    window. With ``individual`` each row's rate is returned, ``row_key, value, m``.
    """
    if feature not in cp.features:
        raise ValidationError(f"{feature!r} is no feature")
    spark = cp.df.sparkSession
    keyed = cp.df.withColumn("row_key", F.struct(cp.id, cp.start))
    table = spark.createDataFrame([(float(v),) for v in values], "value double")
    opened = keyed.drop(feature).crossJoin(F.broadcast(table)).withColumn(feature, F.col("value"))  # few values
    edges = [(m, float(lo), float(hi)) for m, (lo, hi) in enumerate(zip(windows, windows[1:], strict=False))]
    cells = spark.createDataFrame(edges, "m int, lo double, hi double")
    curve = predict(opened, ["row_key", "value"])
    low = curve.join(F.broadcast(cells.select("m", F.col("lo").alias("t"))), "t").select("row_key", "value", "m", F.col("cumhaz").alias("h_lo"))
    high = curve.join(F.broadcast(cells.select("m", F.col("hi").alias("t"), (F.col("hi") - F.col("lo")).alias("width"))), "t").select("row_key", "value", "m", "width", F.col("cumhaz").alias("h_hi"))
    rates = low.join(high, ["row_key", "value", "m"]).withColumn("rate", (F.col("h_hi") - F.col("h_lo")) / F.col("width"))
    at_risk = exposures(cp.with_df(keyed), windows).select("row_key", "m", "exposure", F.col(feature).alias("_x"))
    joined = rates.join(at_risk, ["row_key", "m"])
    if individual:
        return joined.select("row_key", "value", "m", "rate")
    support = at_risk.groupBy("m").agg(F.percentile("_x", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    out = joined.groupBy("value", "m").agg((F.sum(F.col("exposure") * F.col("rate")) / F.sum("exposure")).alias("hazard"))
    every = table.crossJoin(cells.select("m")).join(out, ["value", "m"], "left").join(F.broadcast(support), "m", "left")  # few cells
    inside = (F.col("value") >= F.element_at("_q", 1)) & (F.col("value") <= F.element_at("_q", 2))
    return every.select("value", "m", "hazard", F.coalesce(inside, F.lit(False)).alias("supported"))


def default_values(df: DataFrame, feature: str, n: int = 20) -> list[float]:
    """Up to ``n`` quantiles of a feature."""
    cuts = F.array(*(F.lit(i / (n - 1)) for i in range(n)))
    return sorted(set(df.agg(F.percentile(feature, cuts).alias("q")).first().q or []))


def shifted_path(df: DataFrame, feature: str, delta: Column | float, from_time: float, start: str = "start", stop: str = "stop") -> DataFrame:
    """Path rows cut at ``from_time`` with the feature shifted from there on; ``delta`` is added or, as a column, replaces it."""
    cut = split_at_time(df, F.lit(float(from_time)), "_later", start, stop, event="_none")
    new = delta if isinstance(delta, Column) else F.col(feature) + F.lit(float(delta))
    return cut.withColumn(feature, F.when(F.col("_later"), new).otherwise(F.col(feature))).drop("_later")


def path_effect(df: DataFrame, feature: str, delta, from_time: float, horizons: list[float], predict: Callable[[DataFrame], DataFrame], path: str = "id") -> DataFrame:
    """``path, t, base, shifted, effect``: risks along paths with and without the shift.

    ``predict(rows)`` returns ``path, t, risk`` at the horizons. Paths that
    ``from_time`` or a horizon lies outside of raise.
    """
    spans = df.groupBy(path).agg(F.min("start").alias("a"), F.max("stop").alias("z"))
    bad = spans.where((F.col("a") > from_time) | (F.col("z") < max(horizons)) | (F.col("z") < from_time)).count()
    if bad:
        raise ValidationError(f"{bad} paths do not cover from_time and the horizons")
    base = predict(df).select(path, "t", F.col("risk").alias("base"))
    moved = predict(shifted_path(df, feature, delta, from_time)).select(path, "t", F.col("risk").alias("shifted"))
    return base.join(moved, [path, "t"]).withColumn("effect", F.col("shifted") - F.col("base"))
