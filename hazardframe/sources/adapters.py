"""Counting-process rows from event logs, visits, wide period tables and registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_event_log(log: DataFrame, id: str, time: str, terminal: Column, values: dict[str, Column], horizon: float | None = None) -> DataFrame:
    """One row per id between its distinct times, up to its first terminal time.

    ``terminal`` is a label (null where an entry is not terminal; the least label
    of a time counts), ``values`` are aggregates over the entries of a time. Rows
    are cut, censored, at ``horizon`` after the first time.
    """
    at = log.groupBy(F.col(id).alias("id"), F.col(time).alias("t")).agg(F.min(terminal).alias("_label"), *(v.alias(k) for k, v in values.items()))
    whole = Window.partitionBy("id")
    ordered = whole.orderBy("t")
    rows = at.withColumns(
        {
            "_first": F.min("t").over(whole),
            "_end": F.min(F.when(F.col("_label").isNotNull(), F.col("t"))).over(whole),
            "_end_label": F.min_by("_label", F.when(F.col("_label").isNotNull(), F.col("t"))).over(whole),
            "_next": F.lead("t").over(ordered),
        }
    )
    cut = F.col("_first") + horizon if horizon is not None else F.lit(None).cast("double")
    rows = rows.where((F.col("_end").isNull() | (F.col("t") < F.col("_end"))) & (cut.isNull() | (F.col("t") < cut)))
    stop = F.least(F.coalesce("_next", "_end", cut), F.coalesce("_end", cut), cut) if horizon is not None else F.coalesce("_next", "_end")
    rows = rows.withColumn("stop", stop)
    event = F.when(F.col("stop") == F.col("_end"), F.col("_end_label")).otherwise(0)
    return rows.where(F.col("t") < F.col("stop")).select("id", F.col("t").alias("start"), "stop", event.cast("long").alias("event"), *values)


def from_visits(visits: DataFrame, id: str, time: str, end: str, status: str) -> DataFrame:
    """Rows from visit to visit; the last ends at ``end`` with the id's status. Visits at or after it are left out."""
    w = Window.partitionBy(id).orderBy(time)
    rows = visits.where(F.col(time) < F.col(end)).withColumn("stop", F.coalesce(F.lead(time).over(w), F.col(end)).cast("double"))
    last = F.lead(time).over(w).isNull()
    others = [c for c in visits.columns if c not in (id, time, end, status)]
    return rows.select(F.col(id).alias("id"), F.col(time).cast("double").alias("start"), "stop", F.when(last, F.col(status)).otherwise(0).cast("long").alias("event"), *others)


def from_wide_periods(wide: DataFrame, id: str, end: str, event: str, periods: list[str], value: str) -> DataFrame:
    """One column per unit period to rows of constant value; periods past ``end`` are left out."""
    number = {c: i for i, c in enumerate(periods)}
    long = wide.unpivot([id, end, event], periods, "_period", value)
    places = F.create_map(*(x for c, i in number.items() for x in (F.lit(c), F.lit(i))))
    long = long.withColumn("_k", places[F.col("_period")].cast("double")).where(F.col("_k") < F.col(end))
    w = Window.partitionBy(id).orderBy("_k")
    change = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | F.lag("_k").over(w).isNull()
    long = long.withColumn("_run", F.sum(change.cast("int")).over(w))
    runs = long.groupBy(id, end, event, "_run").agg(F.min("_k").alias("start"), (F.max("_k") + 1).alias("_stop"), F.first(value).alias(value))
    stop = F.least(F.col("_stop"), F.col(end).cast("double"))
    rows = runs.withColumn("stop", stop).withColumn("_last", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("_run"))) == 1)
    return rows.select(F.col(id).alias("id"), "start", "stop", F.when(F.col("_last"), F.col(event)).otherwise(0).cast("long").alias("event"), value)


def split_at_time(df: DataFrame, at: Column, flag: str, start: str = "start", stop: str = "stop", event: str = "event") -> DataFrame:
    """Cut the rows that straddle ``at`` in two; ``flag`` tells the pieces that begin there or later."""
    s, e = F.col(start), F.col(stop)
    inside = (s < at) & (at < e)
    piece = lambda a, z, ev, on: F.struct(a.alias("a"), z.alias("z"), ev.alias("e"), on.alias("f"))
    none = F.lit(0).cast(df.schema[event].dataType) if event in df.columns else F.lit(0)
    label = F.col(event) if event in df.columns else F.lit(0)
    two = F.array(piece(s, at, none, F.lit(False)), piece(at, e, label, F.lit(True)))
    one = F.array(piece(s, e, label, F.coalesce(s >= at, F.lit(False))))
    rows = df.withColumn("_piece", F.explode(F.when(inside, two).otherwise(one)))
    new = {start: F.col("_piece.a"), stop: F.col("_piece.z"), flag: F.col("_piece.f")}
    if event in df.columns:
        new[event] = F.col("_piece.e")
    return rows.withColumns(new).drop("_piece")


def repair_overlaps(df: DataFrame, id: str = "id", start: str = "start", stop: str = "stop", event: str = "event", required: list[str] | None = None) -> DataFrame:
    """Rows begin no earlier than the row before ends, end with the id's first event, and have no null in ``required``."""
    w = Window.partitionBy(id).orderBy(start, stop)
    rows = df.na.drop(subset=required) if required else df
    rows = rows.withColumn(start, F.greatest(F.col(start), F.coalesce(F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(start))))
    earlier = F.coalesce(F.sum((F.col(event) != 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_earlier", earlier).where((F.col("_earlier") == 0) & (F.col(start) < F.col(stop))).drop("_earlier")
