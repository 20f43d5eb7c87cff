"""Counting-process rows: column roles and the rules that rows must keep.

A row ``(id, start, stop, event, features)`` holds on ``(start, stop]``; it is at
risk at ``t`` if ``start < t <= stop``. ``event`` is 0 where the row is censored,
or the label of a cause. The rows of an id are one or several chains of contiguous
rows, and an event ends a chain.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.errors import ValidationError
from hazardframe.functions import numbered, value_cell

#: Most causes that a target may have.
MAX_CAUSES = 255


@dataclass(frozen=True)
class CountingProcess:
    """A DataFrame with the roles of its columns."""

    df: DataFrame
    id: str = "id"
    start: str = "start"
    stop: str = "stop"
    event: str = "event"
    features: tuple[str, ...] = field(default=())
    measured_at: str | None = None

    def with_df(self, df: DataFrame, **roles) -> CountingProcess:
        return replace(self, df=df, **roles)

    def __post_init__(self):
        need = [self.id, self.start, self.stop, self.event, *self.features]
        missing = [c for c in need if c not in self.df.columns]
        if missing:
            raise TypeError(f"columns {missing} are not in the frame")
        clash = {self.id, self.start, self.stop, self.event} & set(self.features)
        if clash:
            raise TypeError(f"{sorted(clash)} cannot be features")

    @property
    def chain(self) -> Window:
        return Window.partitionBy(self.id).orderBy(self.start)


def survival_target(df: DataFrame, stop: str = "stop", event: str = "event", start: str | None = None) -> DataFrame:
    """``start, stop, event`` as doubles and a boolean; without a start column rows begin at 0."""
    kind = df.schema[event].dataType.simpleString()
    if kind not in ("boolean", "tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"event must be boolean or 0/1, got {kind}")
    flag = F.col(event) if kind == "boolean" else F.when(F.col(event).isin(0, 1), F.col(event) == 1)
    begin = F.col(start).cast("double") if start else F.lit(0.0)
    return df.select(begin.alias("start"), F.col(stop).cast("double").alias("stop"), flag.alias("event"))


def competing_target(df: DataFrame, stop: str = "stop", event: str = "event", start: str | None = None) -> DataFrame:
    """``start, stop, event`` with the event as a non-negative label; others become null."""
    kind = df.schema[event].dataType.simpleString()
    value = F.col(event).cast("int") if kind == "boolean" else F.col(event)
    label = F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))
    begin = F.col(start).cast("double") if start else F.lit(0.0)
    return df.select(begin.alias("start"), F.col(stop).cast("double").alias("stop"), label.alias("event"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def with_structure(cp: CountingProcess) -> DataFrame:
    """Rows with what the layout rules look at: ``_overlap``, ``_gap``, ``_early_event``."""
    before = F.lag(cp.stop).over(cp.chain)
    after = F.lead(cp.start).over(cp.chain)
    start = F.col(cp.start)
    return cp.df.withColumns(
        {
            "_overlap": F.coalesce(start < before, F.lit(False)),
            "_gap": F.coalesce(start > before, F.lit(False)),
            "_early_event": after.isNotNull() & (F.col(cp.event) != 0),
        }
    )


def validation_summary(cp: CountingProcess) -> DataFrame:
    """One row of counts of rows that break each rule; one shuffle by id."""
    start, stop = F.col(cp.start).cast("double"), F.col(cp.stop).cast("double")
    label = F.col(cp.event)
    look = F.col(cp.measured_at) > F.col(cp.start) if cp.measured_at else F.lit(False)
    return with_structure(cp).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(cp.id).alias("n_ids"),
        _count(F.col(cp.id).isNull()).alias("n_null_id"),
        _count(~(_finite(start) & _finite(stop))).alias("n_not_finite"),
        _count(start >= stop).alias("n_empty"),
        _count(label.isNull() | (label < 0) | (label != F.floor(label))).alias("n_bad_label"),
        _count(label != 0).alias("n_events"),
        _count(F.col("_overlap")).alias("n_overlap"),
        _count(F.col("_gap")).alias("n_gap"),
        _count(F.col("_early_event")).alias("n_early_event"),
        _count(look).alias("n_look_ahead"),
    )


def validate(cp: CountingProcess, gap_policy: str = "error", layout: str = "counting_process", require_events: bool = True) -> CountingProcess:
    """Raise on rows that break a rule; with ``gap_policy="split_id"`` gaps start new chains.

    ``layout="stacked"`` checks intervals and labels alone, as ids then only group rows.
    """
    if gap_policy not in ("error", "split_id") or layout not in ("counting_process", "stacked"):
        raise ValueError(f"unknown gap_policy {gap_policy!r} or layout {layout!r}")
    found = validation_summary(cp).first().asDict()
    rules = {"n_null_id": "ids are null", "n_not_finite": "times are not finite", "n_empty": "start is not before stop", "n_bad_label": "event is no label", "n_look_ahead": "values were measured after the row's start"}
    if layout != "stacked":
        rules |= {"n_overlap": "rows of an id overlap", "n_early_event": "an event is not on its id's last row"}
        if gap_policy == "split_id":
            rules.pop("n_early_event")
        else:
            rules["n_gap"] = "rows of an id leave a gap"
    for name, what in rules.items():
        if found[name]:
            raise ValidationError(f"{found[name]} rows: {what}")
    if require_events and not found["n_events"]:
        raise ValidationError("there is no event")
    if layout != "stacked" and gap_policy == "split_id":
        chained = cp.with_df(split_segments(cp), id="chain")
        early = with_structure(chained.with_df(chained.df.withColumn("chain", F.struct(cp.id, "segment")))).where("_early_event").count()
        if early:
            raise ValidationError(f"{early} rows: an event is not on its chain's last row")
    return cp


def split_segments(cp: CountingProcess) -> DataFrame:
    """Rows with ``segment`` (contiguous runs of an id, from 0) and ``chain`` (id and segment)."""
    rows = with_structure(cp)
    segment = F.sum(F.col("_gap").cast("int")).over(cp.chain).cast("long")
    return rows.withColumn("segment", segment).withColumn("chain", F.struct(F.col(cp.id), F.col("segment"))).drop("_overlap", "_gap", "_early_event")


def look_ahead(cp: CountingProcess) -> DataFrame:
    """Rows whose values were measured after the row's start."""
    return cp.df.where(F.col(cp.measured_at) > F.col(cp.start))


def cause_vocabulary(cp: CountingProcess) -> DataFrame:
    """The causes that occur: ``cause``, ``code`` (from 1, in order) and ``n`` events."""
    seen = cp.df.where(F.col(cp.event) != 0).groupBy(F.col(cp.event).cast("long").alias("cause")).agg(F.count("*").alias("n"))
    return seen.withColumn("code", F.row_number().over(Window.orderBy("cause")).cast("long")).select("cause", "code", "n")


def encode_causes(cp: CountingProcess, causes: list[int] | None = None) -> tuple[CountingProcess, list[int]]:
    """Labels as codes 1..J in the order of the vocabulary; unknown labels raise."""
    seen = [r.cause for r in cause_vocabulary(cp).orderBy("cause").limit(MAX_CAUSES + 1).collect()]
    causes = sorted({int(c) for c in (causes if causes is not None else seen)})
    if not causes or causes[0] <= 0 or len(causes) > MAX_CAUSES:
        raise ValidationError("causes must be 1 to 255 positive labels")
    if unknown := sorted(set(seen) - set(causes)):
        raise ValidationError(f"labels {unknown} are not among the causes")
    code = F.lit(0)
    for j, c in enumerate(causes):
        code = F.when(F.col(cp.event) == c, j + 1).otherwise(code)
    return cp.with_df(cp.df.withColumn(cp.event, code.cast("long"))), causes


def unit_codes(df: DataFrame, unit: str, row_key: str) -> DataFrame:
    """``unit_code`` numbers the units from 0 in the order of their first ``row_key``.

    Row keys that are no numbers are ordered in one task, as no bounded set of cells follows their order.
    """
    first = df.groupBy(unit).agg(F.min(row_key).alias("_first"))
    cell, follows = value_cell(first, "_first")
    codes = numbered(first, "unit_code", ["_first"], cell if follows else F.lit(0).cast("long"))
    return df.join(codes.drop("_first"), unit)


def fingerprint(df: DataFrame, options: dict | None = None) -> str:
    """A digest of rows (in any order) and options, to tell whether data are those of a fit."""
    h = F.xxhash64(*sorted(df.columns))
    row = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).first()
    return json.dumps([row.n, row.x, row.s, sorted(df.columns), options or {}], sort_keys=True)
