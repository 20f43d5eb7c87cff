"""Reshaping of counting-process rows: encoding, imputation, grids, blocks, bins, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.errors import ValidationError
from hazardframe.frame import CountingProcess
from hazardframe.functions import clock_cell, numbered, steps_below, window_exposure

#: Most pieces that one row may be cut into.
MAX_PIECES = 1000
#: Whole numbers from here on have no exact neighbours as doubles.
EXACT = 2.0**52


class CategoryEncoder:
    """Indicators ``column=level`` over the sorted observed levels; missing values make all of them null."""

    def __init__(self, categorical: list[str] | None = None):
        self.categorical = categorical

    def fit(self, df: DataFrame, features: list[str]) -> CategoryEncoder:
        kinds = dict(df.dtypes)
        named = set(self.categorical or ())
        if named - set(features):
            raise ValidationError(f"{sorted(named - set(features))} are no features")
        self.features = list(features)
        nominal = [f for f in features if f in named or kinds[f] in ("string", "binary")]
        self.levels: dict[str, list] = {}
        if nominal:
            # one pass: the levels of all columns as (column, level) pairs
            pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in nominal)))
            found: dict[str, list] = {f: [] for f in nominal}
            for r in df.select(pairs.alias("p")).select("p.f", "p.v").distinct().where("v is not null").collect():
                found[r.f].append(r.v)
            for f in nominal:
                if not found[f]:
                    raise ValidationError(f"column {f!r} has no level")
                number = kinds[f] not in ("string", "binary")
                self.levels[f] = sorted(found[f], key=float if number else str)
        self.names = [n for f in features for n in ([f"{f}={v}" for v in self.levels[f]] if f in self.levels else [f])]
        return self

    def expand(self, columns: list[str]) -> list[int]:
        """Places of the encoded columns that come from ``columns``."""
        want = {n for f in columns for n in ([f"{f}={v}" for v in self.levels[f]] if f in self.levels else [f])}
        return [i for i, n in enumerate(self.names) if n in want]

    def unseen(self, df: DataFrame) -> dict[str, list]:
        """Levels of ``df`` that were not there when fitting."""
        out = {}
        for f, levels in self.levels.items():
            new = df.select(F.col(f).cast("string").alias("v")).where(F.col("v").isNotNull() & ~F.col("v").isin(levels)).distinct().limit(10).collect()
            if new:
                out[f] = sorted(r.v for r in new)
        return out

    def transform(self, df: DataFrame, unknown: str = "error") -> DataFrame:
        """Numeric features as doubles (NaN as null) and indicators; other columns stay."""
        if unknown not in ("error", "missing"):
            raise ValueError(f"unknown must be 'error' or 'missing', got {unknown!r}")
        if unknown == "error" and (new := self.unseen(df)):
            raise ValidationError(f"unseen levels {new}")
        out = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        for f in self.features:
            if f in self.levels:
                value = F.col(f).cast("string")
                known = value.isin(self.levels[f])
                out += [F.when(known, (value == v).cast("double")).alias(f"{f}={v}") for v in self.levels[f]]
            else:
                x = F.col(f).cast("double")
                out.append(F.when(~F.isnan(x), x).alias(f))
        return df.select(*out)


def impute_locf(df: DataFrame, id: str, order: str, columns: list[str]) -> DataFrame:
    """Carry the last value that is not missing forward in each id; what has none before stays missing."""
    w = Window.partitionBy(id).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    clean = {c: F.when(~F.isnan(c), F.col(c)) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes if c in columns}
    return df.withColumns({c: F.last(v, ignorenulls=True).over(w) for c, v in clean.items()})


def exact_grid(cp: CountingProcess) -> DataFrame:
    """The distinct times of events of any cause: ``k`` from 0 and ``t``."""
    times = cp.df.where(F.col(cp.event) != 0).select(F.col(cp.stop).cast("double").alias("t")).distinct()
    return numbered(times, "k", ["t"], clock_cell(F.col("t"))).select("k", "t")


def quantile_grid(cp: CountingProcess, size: int) -> DataFrame:
    """Event times at ranks ``ceil(j n / size)`` of the ``n`` distinct ones; all of them if ``size`` is no less."""
    ranked = exact_grid(cp).select((F.col("k") + 1).cast("long").alias("r"), "t")
    total = ranked.agg(F.max("r").alias("n"))
    both = ranked.crossJoin(F.broadcast(total))  # one row
    # rank r is picked if some j has ceil(j n / size) = r, that is floor(r size / n) > floor((r - 1) size / n)
    pick = F.expr(f"(r * {size}) div n > ((r - 1) * {size}) div n")
    return both.where((F.col("n") <= size) | pick).select((F.row_number().over(Window.orderBy("t")) - 1).alias("k"), "t")


def coarsen(cp: CountingProcess, grid: list[float], lost: bool = False) -> DataFrame:
    """Times moved up to the grid (the earliest start belongs to it), beyond its last point to that.

    Rows whose interval vanishes are dropped; an event of theirs goes to the
    row kept before it in the chain, or is lost. ``lost`` returns the lost events.
    """
    first = cp.df.agg(F.min(cp.start)).first()[0]
    points = sorted({float(first), *(float(t) for t in grid if t > first)}) if first is not None else []
    if not points:
        return cp.df
    table = F.array(*map(F.lit, points))
    up = lambda c: F.element_at(table, F.least(steps_below(points, F.col(c)), F.lit(len(points) - 1)) + 1)
    rows = cp.df.withColumns({"_a": up(cp.start), "_z": up(cp.stop)}).withColumn("_kept", F.col("_a") < F.col("_z"))
    w = Window.partitionBy(cp.id).orderBy(cp.start)
    # the event of dropped rows that directly follow a kept one, taken from the rows up to the next kept one
    run = F.sum(F.col("_kept").cast("int")).over(w)
    rows = rows.withColumn("_run", run)
    moved = F.max(F.when(~F.col("_kept"), F.col(cp.event))).over(Window.partitionBy(cp.id, "_run"))
    rows = rows.withColumn("_moved", F.coalesce(moved, F.lit(0)))
    if lost:
        return rows.where((F.col("_run") == 0) & ~F.col("_kept") & (F.col(cp.event) != 0)).select(*cp.df.columns)
    event = F.when(F.col(cp.event) != 0, F.col(cp.event)).otherwise(F.col("_moved")).cast(cp.df.schema[cp.event].dataType)
    kept = rows.where("_kept").withColumns({cp.event: event, cp.start: F.col("_a"), cp.stop: F.col("_z")})
    return kept.select(*cp.df.columns)


def split_blocks(cp: CountingProcess, length: float) -> DataFrame:
    """Rows split so that each part lies in one block of time; adds the columns ``piece`` and ``block``.

    Block ``k`` is the time after ``k length`` up to ``(k + 1) length``. A row has a
    part in every block that it meets, which are looked for among those near its
    ends, so rounding never moves an edge: edges are always the product of a whole
    number and the length. The last part, which ends where the row does, keeps the
    event. This is arithmetic on each row; nothing is shuffled.
    """
    size = F.lit(float(length))
    start, stop = F.col(cp.start).cast("double"), F.col(cp.stop).cast("double")
    begins, ends = lambda k: k.cast("double") * size, lambda k: (k + 1).cast("double") * size
    failed = lambda why: F.raise_error(F.lit(why)).cast("array<bigint>")
    many = failed(f"a row meets over {MAX_PIECES} blocks of length {length}: take longer blocks")
    far = failed(f"times of 2^52 blocks of length {length} and more have no exact edges: take longer blocks or another unit of time")
    near = F.when(F.greatest(F.abs(start), F.abs(stop)) / size >= EXACT, far).when((stop - start) / size > MAX_PIECES, many).otherwise(F.sequence(F.floor(start / size) - 1, F.floor(stop / size) + 1))
    met = F.filter(near, lambda k: (begins(k) < stop) & (ends(k) > start))
    rows = cp.df.withColumn("_met", met).withColumn("_met", F.when(F.size("_met") > MAX_PIECES, many).otherwise(F.col("_met")))
    parts = rows.select(*cp.df.columns, F.posexplode("_met").alias("piece", "block")).withColumn("piece", F.col("piece").cast("long"))
    k = F.col("block")
    event = F.when(ends(k) >= stop, F.col(cp.event)).otherwise(F.lit(0).cast(cp.df.schema[cp.event].dataType))
    return parts.withColumns({cp.start: F.greatest(start, begins(k)), cp.stop: F.least(stop, ends(k)), cp.event: event})


def block_units(pieces: DataFrame, id: str = "id") -> DataFrame:
    """The resampling units ``(id, block)`` and their numbers of rows."""
    return pieces.groupBy(id, "block").agg(F.count("*").alias("n_rows"))


def oob_sets(rows: DataFrame, units: DataFrame, buffer: int, id: str = "id") -> DataFrame:
    """Units of its id within ``buffer`` blocks of each row (columns ``row_key``, ``lo``, ``hi`` of blocks).

    The band is opened into its few blocks, which makes the join an equality.
    """
    wide = rows.select(F.col(id), "row_key", F.explode(F.sequence(F.col("lo") - buffer, F.col("hi") + buffer)).alias("block"))
    return wide.join(units.select(id, "block"), [id, "block"]).select("row_key", id, "block")


def approximate_edges(df: DataFrame, features: list[str], max_bins: int, accuracy: int = 10_000) -> DataFrame:
    """:func:`feature_edges` from mergeable quantile sketches: one aggregate, no ordering of values.

    Features of few values get edges at values and not midway between them.
    """
    cuts = [q / max_bins for q in range(1, max_bins)]
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    sketches = [F.struct(F.lit(f).alias("feature"), F.percentile_approx(x, cuts, accuracy).alias("e"), F.max(x).alias("top")) for f, x in zip(features, clean, strict=True)]
    rows = df.agg(F.array(*sketches).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    inner = rows.select("feature", F.explode(F.array_distinct(F.filter("e", lambda x: x < F.col("top")))).alias("edge"))
    return inner.select("feature", (F.row_number().over(Window.partitionBy("feature").orderBy("edge")) - 1).alias("j"), "edge")


def feature_edges(df: DataFrame, features: list[str], max_bins: int) -> DataFrame:
    """Upper edges of bins: ``feature``, ``j`` from 0, ``edge``.

    With at most ``max_bins`` distinct values the edges lie midway between them,
    else at the values of ranks ``q n / max_bins`` without repeats and the largest.
    All features go through one grouping and one window by feature.
    """
    x = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features)))
    values = df.select(x.alias("p")).select("p.feature", "p.x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = values.groupBy("feature", "x").agg(F.count("*").alias("c"))
    by, ordered = Window.partitionBy("feature"), Window.partitionBy("feature").orderBy("x")
    counts = counts.withColumns(
        {
            "n": F.sum("c").over(by),
            "n_distinct": F.count("*").over(by),
            "upto": F.sum("c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.lead("x").over(ordered),
            "top": F.max("x").over(by),
        }
    )
    middle = F.col("x") + (F.col("next") - F.col("x")) / 2
    few = F.col("n_distinct") <= max_bins
    # a zero-based rank floor(q n / max_bins), 0 < q < max_bins, falls on this value
    before = F.col("upto") - F.col("c")
    low_q = F.expr(f"(before * {max_bins} + n - 1) div n")
    picked = (F.greatest(low_q, F.lit(1)) < max_bins) & (F.expr("(q * n) div %d" % max_bins) < F.col("upto"))
    counts = counts.withColumn("before", before).withColumn("q", F.greatest(low_q, F.lit(1)).cast("long"))
    edge = F.when(few & F.col("next").isNotNull(), middle).when(~few & picked & (F.col("x") < F.col("top")), F.col("x"))
    edges = counts.withColumn("edge", edge).where("edge is not null")
    return edges.select("feature", (F.row_number().over(Window.partitionBy("feature").orderBy("edge")) - 1).alias("j"), "edge")


def bin_columns(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Each feature's bin (the number of edges below the value) as ``<feature>_bin``; null where missing."""
    out = {}
    for f, e in edges.items():
        x = F.col(f).cast("double")
        out[f"{f}_bin"] = F.when(x.isNotNull() & ~F.isnan(x), steps_below(e, x) if e else F.lit(0)).cast("int")
    return df.withColumns(out)


def censor_at(cp: CountingProcess, cutoff: float) -> DataFrame:
    """What is known at ``cutoff``: rows that began before it, cut there, with later events censored."""
    late = F.col(cp.stop) > cutoff
    none = F.lit(0).cast(cp.df.schema[cp.event].dataType)
    rows = cp.df.where(F.col(cp.start) < cutoff)
    return rows.withColumns({cp.event: F.when(late, none).otherwise(F.col(cp.event)), cp.stop: F.least(F.col(cp.stop), F.lit(float(cutoff)))})


def exposures(cp: CountingProcess, windows: list[float]) -> DataFrame:
    """Time of each row in each window ``(w_m, w_m+1]`` that it meets: ``m`` and ``exposure``; no join, no shuffle."""
    cells = [F.struct(F.lit(m).alias("m"), window_exposure(F.col(cp.start), F.col(cp.stop), lo, hi).alias("e")) for m, (lo, hi) in enumerate(zip(windows, windows[1:], strict=False))]
    rows = cp.df.withColumn("_c", F.explode(F.filter(F.array(*cells), lambda c: c.e > 0)))
    return rows.withColumns({"m": F.col("_c.m"), "exposure": F.col("_c.e")}).drop("_c")


def quantile_codes(df: DataFrame, column: str, n: int, by: list[str] | None = None) -> DataFrame:
    """``code``: the value's rank if there are at most ``n`` distinct ones, else its quantile bin, closed on the right.

    Missing values are left out of the quantiles and get a null code.
    """
    cuts = [i / n for i in range(1, n)]
    group = list(by or [])
    stats = df.groupBy(*group).agg(
        F.percentile(column, F.array(*map(F.lit, cuts))).alias("_cuts") if cuts else F.array().cast("array<double>").alias("_cuts"),
        F.countDistinct(column).alias("_distinct"),
    )
    joined = df.join(stats, group) if group else df.crossJoin(F.broadcast(stats))  # one row
    # only groups of at most n values are ranked
    few = joined.where((F.col("_distinct") <= n) & F.col(column).isNotNull()).select(*group, column).distinct()
    values = few.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(column)) - 1)
    joined = joined.join(values, [*group, column], "left")
    below = F.size(F.filter(F.array_distinct("_cuts"), lambda e: e < F.col(column)))
    code = F.when(F.col(column).isNull(), None).when(F.col("_distinct") <= n, F.col("_rank")).otherwise(below)
    return joined.withColumn("code", code.cast("long")).drop("_cuts", "_distinct", "_rank")


def cross_codes(df: DataFrame, columns: list[str], name: str = "stratum") -> DataFrame:
    """One dense code for each combination of ``columns`` that occurs; nulls raise."""
    missing = F.greatest(*(F.col(c).isNull() for c in columns)) if len(columns) > 1 else F.col(columns[0]).isNull()
    checked = df.withColumn("_ok", F.when(missing, F.raise_error(F.lit("strata must not be missing")).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")
    codes = checked.select(*columns).distinct().withColumn(name, (F.row_number().over(Window.orderBy(*columns)) - 1).cast("long"))
    return checked.join(codes, columns)


def noise_column(df: DataFrame, key: str, seed: int, name: str = "noise") -> DataFrame:
    """A normal deviate per row, the same for the same key and seed wherever the row lies."""
    unit = lambda s: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(s)), F.lit(1 << 52)).cast("double") + 1) / F.lit(float((1 << 52) + 1))
    return df.withColumn(name, F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2)))
