"""Survival and competing-risks forests on counting-process rows.

Fitting rewrites rows by plans (encoding, coarse grid, blocks, bins), draws bags by
hash, and grows each tree from its bag's rows in one Arrow task; predictions are
lazy DataFrames. Nodes of more than ``max_node_rows`` rows are split from histograms
first; ``ntime`` bounds the event times, and ``binning="approximate"`` finds bins
from quantile sketches where features have too many values to order.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe import frame
from hazardframe.errors import ValidationError
from hazardframe.forest import arrays, frames, kernel, levels
from hazardframe.frame import CountingProcess
from hazardframe.functions import steps_below
from hazardframe.operators import estimators as est
from hazardframe.operators import metrics, reshape

FORMAT_VERSION = 1
WAYS = ("right", "left", "alone")


class Parameters:
    """Named parameters, readable, settable and copied by :meth:`clone`."""

    defaults: dict = {}

    def __init__(self, **given):
        unknown = set(given) - set(self.defaults)
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        for name, value in {**self.defaults, **given}.items():
            setattr(self, name, value)

    def get_params(self) -> dict:
        return {name: getattr(self, name) for name in self.defaults}

    def set_params(self, **given):
        for name, value in given.items():
            if name not in self.defaults:
                raise ValueError(f"unknown parameter {name!r}")
            setattr(self, name, value)
        return self

    def clone(self):
        return type(self)(**self.get_params())

    def __repr__(self):
        changed = ", ".join(f"{k}={v!r}" for k, v in self.get_params().items() if v != self.defaults[k])
        return f"{type(self).__name__}({changed})"


def _whole(name: str, value, low: int, high: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must lie in [{low}, {high}]")


class _Forest(Parameters):
    defaults = {
        "n_estimators": 500,
        "max_features": "sqrt",
        "max_depth": None,
        "min_ids_leaf": 15,
        "min_events_leaf": 3,
        "max_bins": 255,
        "ntime": None,
        "resample_unit": "id",
        "block_length": None,
        "oob_buffer": 1,
        "max_samples": None,
        "bootstrap": False,
        "aggregate": "hazard",
        "oob_score": False,
        "n_jobs": None,
        "random_state": None,
        "max_node_rows": 2_000_000,
        "binning": "exact",
    }
    competing = False
    aggregates: tuple[str, ...] = ("hazard", "survival")

    # ---- parameters

    def _check(self) -> None:
        _whole("n_estimators", self.n_estimators, 1)
        _whole("max_bins", self.max_bins, 2, 256)
        _whole("min_events_leaf", self.min_events_leaf, 1)
        _whole("oob_buffer", self.oob_buffer, 0, 1_000_000)
        _whole("max_node_rows", self.max_node_rows, 1)
        if self.binning not in ("exact", "approximate"):
            raise ValueError("binning must be 'exact' or 'approximate'")
        if self.max_depth is not None:
            _whole("max_depth", self.max_depth, 0)
        if self.ntime is not None:
            _whole("ntime", self.ntime, 1)
        if self.min_ids_leaf != "auto":
            _whole("min_ids_leaf", self.min_ids_leaf, 1)
        if self.resample_unit not in ("id", "block"):
            raise ValueError("resample_unit must be 'id' or 'block'")
        if (self.resample_unit == "block") != (self.block_length is not None):
            raise ValueError("block_length goes with resample_unit='block'")
        if self.aggregate not in self.aggregates:
            raise ValueError(f"aggregate must be one of {self.aggregates}")

    def _min_units(self, n_units: int) -> int:
        return max(15, math.isqrt(n_units)) if self.min_ids_leaf == "auto" else self.min_ids_leaf

    def _n_draw(self, n_units: int) -> int:
        share = self.max_samples
        if share is None:
            share = 1.0 if self.bootstrap else 0.632
        if isinstance(share, bool):
            raise TypeError("max_samples must be a number")
        if isinstance(share, int):
            if not 1 <= share <= n_units:
                raise ValueError("max_samples exceeds the number of units")
            return share
        if not 0 < share <= 1:
            raise ValueError("max_samples must lie in (0, 1]")
        return max(1, round(share * n_units))

    def _n_features(self, p: int) -> int:
        m = self.max_features
        if m is None:
            return p
        if m == "sqrt":
            return max(1, math.isqrt(p))
        if m == "log2":
            return max(1, int(math.log2(p)))
        if isinstance(m, bool) or isinstance(m, str):
            raise ValueError(f"max_features={m!r}")
        if isinstance(m, int):
            if not 1 <= m <= p:
                raise ValueError("max_features exceeds the encoded features")
            return m
        if not 0 < m <= 1:
            raise ValueError("max_features must lie in (0, 1]")
        return max(1, int(m * p))

    # ---- fitting

    def fit(self, cp: CountingProcess, *, categorical: list[str] | None = None, gap_policy: str = "error", layout: str = "counting_process", block_time: str | None = None):
        """Grow the forest; returns self. ``block_time`` names a column whose value tells a row's block, instead of cutting rows."""
        self._check()
        spark = cp.df.sparkSession
        needed = dict.fromkeys([cp.id, cp.start, cp.stop, cp.event, *cp.features, *([cp.measured_at] if cp.measured_at else []), *([block_time] if block_time else [])])
        given = cp.df.select(*needed).persist()  # read by the checks, the levels and the design
        cp = cp.with_df(given)
        self.encoder_ = reshape.CategoryEncoder(categorical).fit(cp.df, list(cp.features))
        frame.validate(cp, gap_policy, layout)
        self.fingerprint_ = frame.fingerprint(cp.df, {k: v for k, v in self.get_params().items() if k != "n_jobs"})
        rows, self.causes_ = self._coded(cp)
        names = [f"x{i}" for i in range(len(self.encoder_.names))]
        extra = [block_time] if block_time and block_time not in cp.features else []
        encoded = self.encoder_.transform(rows.df.select(cp.id, cp.start, cp.stop, cp.event, *extra, *cp.features), unknown="missing")
        encoded = encoded.select(
            F.col(cp.id).alias("id"), F.col(cp.start).cast("double").alias("start"), F.col(cp.stop).cast("double").alias("stop"), F.col(cp.event).cast("int").alias("event"),
            (F.col(f"`{block_time}`") if block_time else F.lit(None)).cast("double").alias("block_time"),
            *(F.col(f"`{n}`").alias(x) for n, x in zip(self.encoder_.names, names, strict=True)),
        )
        encoded = encoded.withColumn("row_key", F.xxhash64("id", "start", "stop", "block_time"))
        key = "id"
        if layout != "stacked" and gap_policy == "split_id":
            chained = frame.split_segments(CountingProcess(encoded))
            encoded, key = chained.drop("segment"), "chain"
        work = CountingProcess(encoded, id=key)
        self.coarse_grid_ = None
        if self.ntime is not None:
            grid = [r.t for r in reshape.quantile_grid(work, self.ntime).orderBy("t").collect()]
            self.coarse_grid_ = grid
            work = work.with_df(reshape.coarsen(work, grid))
        block = F.lit(0).cast("long")
        if self.resample_unit == "block":
            if block_time:
                block = F.floor(F.col("block_time") / F.lit(float(self.block_length)))
            else:
                work = work.with_df(reshape.split_blocks(work, float(self.block_length)).drop("piece"))
                block = F.col("block")
        design = work.df.withColumn("block", block).withColumn("unit", F.xxhash64("id", "block"))
        self.design_ = design.persist()
        work = CountingProcess(self.design_)
        self.event_times_ = [r.t for r in reshape.exact_grid(work).orderBy("t").collect()]
        if not self.event_times_:
            raise ValidationError("there is no event")
        edges = {x: [] for x in names}
        edges_of = reshape.feature_edges if self.binning == "exact" else reshape.approximate_edges
        for r in edges_of(self.design_, names, self.max_bins).orderBy("feature", "edge").collect():
            edges[r.feature].append(r.edge)
        self.edges_ = edges
        units = self.design_.select("unit").distinct()
        self.n_rows_, self.n_units_, self.n_ids_ = self.design_.agg(F.count("*"), F.countDistinct("unit"), F.countDistinct("id")).first()
        given.unpersist()
        self.n_encoded_features_ = len(names)
        self.seed_ = int(self.random_state) if self.random_state is not None else 0
        self.bags = frames.draw_bags(units, "unit", self.n_estimators, self._n_draw(self.n_units_), self.seed_, self.bootstrap).persist()
        self._grow(spark, names, edges)
        self.baseline_cumhaz_ = est.nelson_aalen_by_cause(work, list(range(1, len(self.causes_) + 1)))
        self._load_arrays(spark)
        if self.oob_score:
            self._out_of_bag()
        return self

    def _coded(self, cp: CountingProcess) -> tuple[CountingProcess, list[int]]:
        return cp.with_df(cp.df.withColumn(cp.event, (F.col(cp.event) != 0).cast("long"))), [1]

    def _limits(self) -> kernel.Limits:
        return kernel.Limits(self._min_units(self.n_units_), self.min_events_leaf, 0, self.max_depth, self._n_features(self.n_encoded_features_), len(self.causes_), None)

    def _grow(self, spark: SparkSession, names: list[str], edges: dict[str, list[float]]) -> None:
        grid = self.event_times_
        bins = F.array(*(F.coalesce(reshape_bin(F.col(x), edges[x]), F.lit(kernel.MISSING)).cast("smallint") for x in names))
        rows = self.design_.select("unit", bins.alias("bins"), steps_below(grid, F.col("start"), inclusive=True).alias("a"), steps_below(grid, F.col("stop"), inclusive=True).alias("b"), F.col("event").alias("cause"))
        bagged = self.bags.join(rows, "unit").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("tree", "unit", "copy", "bins", "a", "b", "cause")
        limits, seed = self._limits(), self.seed_
        # a bag holds about its share of all rows; larger ones are first split from histograms
        large = self.n_rows_ * self._n_draw(self.n_units_) / self.n_units_ > self.max_node_rows
        if large:
            above, bagged = levels.split_large_nodes(bagged, limits, seed, len(names), self.max_node_rows)
        else:
            above, bagged = [], bagged.withColumn("path", F.lit(1).cast("long"))
        schema = "tree int, path long, kind string, node int, feature int, bin int, missing int, left int, right int, leaf int, k int, cause int, value double"

        def grow(table: pa.Table) -> pa.Table:
            tree, path = int(table.column("tree")[0].as_py()), int(table.column("path")[0].as_py())
            unit, copy = (table.column(c).to_numpy() for c in ("unit", "copy"))
            # an order that depends on the rows alone
            order = np.lexsort((table.column("b").to_numpy(), copy, unit))
            new = np.append(True, (np.diff(unit[order]) != 0) | (np.diff(copy[order]) != 0))
            flat = table.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            part = kernel.Rows(
                np.ascontiguousarray(flat.reshape(table.num_rows, -1)[order].T).astype(np.int64),
                table.column("a").to_numpy()[order].astype(np.int64),
                table.column("b").to_numpy()[order].astype(np.int64),
                table.column("cause").to_numpy()[order].astype(np.int64),
                np.cumsum(new),
            )
            grown = kernel.grow(part, limits, np.random.default_rng([seed, tree, path]), path.bit_length() - 1)
            n = len(grown.feature)
            rows = [("node", i, grown.feature[i], grown.bin[i], grown.missing[i], grown.left[i], grown.right[i], grown.leaf[i], None, None, None) for i in range(n)]
            rows += [("jump", None, None, None, None, None, None, leaf, k, cause, jump) for leaf, k, cause, jump in grown.jumps]
            rows += [("stat", None, None, None, None, None, None, leaf, None, cause, float(events)) for leaf, cause, events in grown.stats]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), *[pa.int32()] * 9, pa.float64()]
            names_ = ["kind", "node", "feature", "bin", "missing", "left", "right", "leaf", "k", "cause", "value"]
            at = [pa.array([tree] * len(rows), pa.int32()), pa.array([path] * len(rows), pa.int64())]
            return pa.table([*at, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["tree", "path", *names_])

        grown = bagged.groupBy("tree", "path").applyInArrow(grow, schema)
        grown = (joined_trees(spark, above, grown) if large else grown).persist()
        known = F.array(*(F.lit(x) for x in self.encoder_.names))
        # thresholds by place: an array of arrays of edges, one for each feature
        table = F.array(*(F.array(*(F.lit(float(e)) for e in edges[x])) if edges[x] else F.array().cast("array<double>") for x in names))
        ways = F.array(*(F.lit(w) for w in WAYS))
        split = F.col("feature") >= 0
        self.nodes = grown.where("kind = 'node'").select(
            "tree", "node",
            F.when(split, F.element_at(known, F.col("feature") + 1)).alias("feature"),
            F.when(split & (F.col("bin") >= 0), F.element_at(F.element_at(table, F.greatest(F.col("feature"), F.lit(0)) + 1), F.greatest(F.col("bin"), F.lit(0)) + 1)).alias("threshold"),
            F.when(split, F.element_at(ways, F.col("missing") + 1)).alias("missing"),
            F.when(split, F.col("left")).alias("left"), F.when(split, F.col("right")).alias("right"),
            F.when(F.col("leaf") >= 0, F.col("leaf")).alias("leaf"),
        )
        times = spark.createDataFrame([(k, float(t)) for k, t in enumerate(grid)], "k int, t double")
        self.leaves = grown.where("kind = 'jump'").join(F.broadcast(times), "k").select("tree", "leaf", "t", "cause", F.col("value").alias("jump"))
        self.leaf_stats = grown.where("kind = 'stat'").select("tree", "leaf", "cause", F.col("value").cast("int").alias("events"))

    def _load_arrays(self, spark: SparkSession) -> None:
        nodes = self.nodes.toArrow().to_pandas().sort_values(["tree", "node"])
        jumps = self.leaves.toArrow().to_pandas().sort_values(["tree", "leaf", "t", "cause"])
        place = {n: i for i, n in enumerate(self.encoder_.names)}
        by_tree = dict(tuple(jumps.groupby("tree")))
        trees = []
        for b, n in nodes.groupby("tree"):
            j = by_tree.get(b)
            column = lambda c, none: n[c].fillna(none).to_numpy()  # noqa: E731, B023
            leaf = column("leaf", -1).astype(np.int64)
            get = lambda c, t: np.zeros(0, t) if j is None else j[c].to_numpy(t)  # noqa: E731, B023
            trees.append(
                arrays.TreeArrays(
                    np.array([place.get(f, 0) for f in n.feature]), column("threshold", np.inf).astype(float), np.array([WAYS.index(m) if m in WAYS else 0 for m in n.missing]),
                    column("left", 0).astype(np.int64), column("right", 0).astype(np.int64), leaf, int(leaf.max()) + 1,
                    get("leaf", np.int64), get("t", float), get("cause", np.int64), get("jump", float),
                )
            )
        self.arrays_ = arrays.ForestArrays(trees, self.encoder_.names, np.asarray(self.event_times_), len(self.causes_))
        self._shared = spark.sparkContext.broadcast(self.arrays_)

    # ---- prediction

    def _encode(self, df: DataFrame, unknown: str = "error") -> DataFrame:
        missing = [f for f in self.encoder_.features if f not in df.columns]
        if missing:
            raise ValidationError(f"features {missing} are not in the frame")
        return self.encoder_.transform(df, unknown)

    @staticmethod
    def _outcomes(cp: CountingProcess, predict) -> DataFrame:
        """``id, start, stop, event`` of every row with its prediction; the outcome is carried along, so no join can mix up rows."""
        roles = {"id": cp.id, "start": cp.start, "stop": cp.stop, "event": cp.event}
        rows = cp.df.select(*(F.col(c).alias(f"_{role}") for role, c in roles.items()), *cp.features)
        made = predict(rows, [f"_{role}" for role in roles])
        return made.select(*(F.col(f"_{role}").alias(role) for role in roles), *(c for c in made.columns if c[1:] not in roles))

    def _times(self, times) -> list[float]:
        out = self.event_times_ if times is None else [float(t) for t in times]
        if any(math.isnan(t) for t in out):
            raise ValueError("times must not be NaN")
        return out

    def _sorted(self, times: list[float]) -> list[float]:
        if times != sorted(times):
            raise ValueError("times must be in order")
        return times

    def _predict(self, df: DataFrame, key: list[str], what: str, times: list[float], allowed: str | None = None, encoded: bool = False) -> DataFrame:
        rows = df if encoded else self._encode(df)
        features = [f"x{i}" for i in range(self.n_encoded_features_)] if encoded else self.encoder_.names
        return arrays.predict(rows, self._shared, features, key, what, times, allowed)

    def apply(self, df: DataFrame, key: list[str]) -> DataFrame:
        """``key, tree, leaf``."""
        return arrays.leaves_of(self._encode(df), self._shared, self.encoder_.names, key)

    def _opened(self, made: DataFrame, key: list[str], times: list[float], name: str) -> DataFrame:
        at = F.array(*(F.lit(t) for t in times))
        return made.select(*key, F.posexplode("_value").alias("_k", name)).select(*key, F.element_at(at, F.col("_k") + 1).alias("t"), name)

    def predict_mortality(self, df: DataFrame, key: list[str]) -> DataFrame:
        """``key, mortality``: the cumulative hazard summed over the event times."""
        if self.aggregate == "survival":
            made = self._predict(df, key, "survival", self.event_times_)
            return made.select(*key, F.aggregate("_value", F.lit(0.0), lambda a, x: a + x).alias("mortality"))
        return self._predict(df, key, "mortality", self.event_times_).select(*key, F.element_at("_value", 1).alias("mortality"))

    def _path(self, df: DataFrame, path: str, origin: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        spans = df.groupBy(path).agg(F.min("start").alias("_a"), F.max("stop").alias("_z"))
        if origin is None:
            origins = spans.select(path, F.col("_a").alias("origin"))
        else:
            origins = spans.join(origin, path)
            if origins.where((F.col("origin") < F.col("_a")) | (F.col("origin") > F.col("_z"))).count():
                raise ValidationError("an origin lies outside of its path")
            origins = origins.select(path, "origin")
        return arrays.leaves_of(self._encode(df), self._shared, self.encoder_.names, [path, "start", "stop"]), origins

    # ---- inspection of trees

    def export_tree(self, tree: int = 0) -> DataFrame:
        return self.nodes.where(F.col("tree") == tree).orderBy("node")

    def leaf_profile(self, tree: int, leaf: int) -> DataFrame:
        """``t, cause, jump, cumhaz`` of one leaf."""
        w = Window.partitionBy("cause").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        return self.leaves.where((F.col("tree") == tree) & (F.col("leaf") == leaf)).select("t", "cause", "jump", F.sum("jump").over(w).alias("cumhaz"))

    def in_bag_units(self, tree: int) -> DataFrame:
        return self.bags.where(F.col("tree") == tree).select("unit", "copies")

    def n_leaves(self, tree: int) -> int:
        return self.arrays_.trees[tree].n_leaves

    def nbytes(self) -> int:
        return sum(a.nbytes for t in self.arrays_.trees for a in vars(t).values() if isinstance(a, np.ndarray))

    def leaf_cause_events_summary(self) -> DataFrame:
        """``cause, min, q10, median, max`` of in-bag events per leaf."""
        q = lambda p: F.percentile("events", F.lit(p))
        return self.leaf_stats.groupBy("cause").agg(F.min("events").alias("min"), q(0.1).alias("q10"), q(0.5).alias("median"), F.max("events").alias("max"))

    # ---- out of bag

    def _required(self) -> DataFrame:
        """``row_key, unit``: the units that a row's trees must not hold."""
        design = self.design_
        if self.resample_unit == "id":
            return design.select("row_key", "unit").distinct()
        rows = design.groupBy("row_key", "id").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
        units = design.select("id", "block", "unit").distinct()
        found = reshape.oob_sets(rows, units, self.oob_buffer)
        return found.join(units, ["id", "block"]).select("row_key", "unit").distinct()

    def oob_rows(self) -> DataFrame:
        """One row per fitted row: the encoded features, target and ``trees`` that may predict it."""
        free = frames.out_of_bag(self._required(), self.bags, self.n_estimators, ["row_key"], ["unit"])
        trees = free.groupBy("row_key").agg(F.collect_list("tree").alias("trees"))
        last = Window.partitionBy("row_key").orderBy(F.desc("stop"))
        first = F.min("start").over(Window.partitionBy("row_key"))
        rows = self.design_.withColumns({"_first": first, "_n": F.row_number().over(last)}).where("_n = 1")
        rows = rows.withColumn("start", F.col("_first")).drop("_first", "_n", "block", "unit", "block_time")
        return rows.join(trees, "row_key", "left")

    # ---- persistence

    def save(self, path: str) -> None:
        """Nodes, leaves, bags and metadata as Parquet under ``path``."""
        spark = self.nodes.sparkSession
        for name in ("nodes", "leaves", "leaf_stats", "bags"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {
            "format_version": FORMAT_VERSION, "class": type(self).__name__, "params": self.get_params(), "causes": self.causes_, "event_times": self.event_times_,
            "features": self.encoder_.features, "levels": self.encoder_.levels, "names": self.encoder_.names, "n_units": self.n_units_, "n_ids": self.n_ids_, "fingerprint": self.fingerprint_,
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        self.baseline_cumhaz_.write.mode("overwrite").parquet(f"{path}/baseline")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        """A forest saved by :meth:`save`, checked for consistency."""
        meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
        if meta["format_version"] > FORMAT_VERSION or meta["class"] != cls.__name__:
            raise ValidationError(f"{path} holds a {meta['class']} of version {meta['format_version']}")
        out = cls(**meta["params"])
        out.encoder_ = reshape.CategoryEncoder()
        out.encoder_.features, out.encoder_.levels, out.encoder_.names = meta["features"], meta["levels"], meta["names"]
        out.causes_, out.event_times_ = meta["causes"], meta["event_times"]
        out.n_units_, out.n_ids_, out.fingerprint_ = meta["n_units"], meta["n_ids"], meta["fingerprint"]
        out.n_encoded_features_ = len(meta["names"])
        for name in ("nodes", "leaves", "leaf_stats", "bags"):
            setattr(out, name, spark.read.parquet(f"{path}/{name}"))
        out.baseline_cumhaz_ = spark.read.parquet(f"{path}/baseline")
        out._check_state()
        out._load_arrays(spark)
        return out

    def _check_state(self) -> None:
        times = self.event_times_
        if any(b <= a for a, b in zip(times, times[1:], strict=False)) or not all(map(math.isfinite, times)):
            raise ValidationError("event times must increase")
        n = F.col
        bad = self.nodes.where((n("leaf").isNull() & ((n("left") <= n("node")) | (n("right") <= n("node")) | n("left").isNull() | n("right").isNull())) | (n("leaf").isNotNull() & n("feature").isNotNull())).count()
        child = self.nodes.select("tree", F.explode(F.array("left", "right")).alias("node")).where("node is not null")
        bad += child.join(self.nodes, ["tree", "node"], "left_anti").count()
        bad += self.leaves.where(~((n("jump") > 0) & (n("jump") <= 1)) | ~n("cause").between(1, len(self.causes_))).count()
        leaf = self.nodes.where("leaf is not null").select("tree", "leaf")
        bad += self.leaves.join(leaf, ["tree", "leaf"], "left_anti").count()
        if self.nodes.select("tree").distinct().count() != self.n_estimators or bad:
            raise ValidationError(f"the saved forest is damaged: {bad} rows")


def joined_trees(spark: SparkSession, above: list, grown: DataFrame) -> DataFrame:
    """Trees whose upper nodes were split from histograms, with the parts that the kernel grew below them.

    Nodes are numbered parents first, leaves in that order. The model is gathered
    on the driver, as it is for prediction anyway.
    """
    parts: dict[tuple[int, int], list] = {}
    for r in grown.collect():
        parts.setdefault((r.tree, r.path), []).append(r)
    upper: dict[tuple[int, int], list] = {}
    for r in above:
        upper.setdefault((r.tree, r.path), []).append(r)
    out = []
    for tree in sorted({t for t, _ in (*parts, *upper)}):
        count = leaves = 0
        todo = [(1, None, None)]  # path, row of the parent, side
        while todo:
            path, parent, side = todo.pop()
            if parent is not None:
                parent[side] = count
            if (tree, path) in parts:
                rows = parts[tree, path]
                base, first = count, leaves
                for r in rows:
                    leaf = None if r.leaf is None else (r.leaf + first if r.leaf >= 0 else -1)
                    shift = lambda x: x + base if x is not None and x >= 0 else x  # noqa: E731, B023
                    out.append([tree, 1, r.kind, shift(r.node), r.feature, r.bin, r.missing, shift(r.left), shift(r.right), leaf, r.k, r.cause, r.value])
                count += sum(r.kind == "node" for r in rows)
                leaves += len({r.leaf for r in rows if r.kind == "stat"})
                continue
            rows = upper[tree, path]
            node = [tree, 1, "node", count, -1, -1, 0, -1, -1, -1, None, None, None]
            out.append(node)
            count += 1
            if rows[0].feature is None:
                node[9] = leaves
                for r in rows:
                    kind, k = ("stat", None) if r.leaf_k == -1 else ("jump", r.leaf_k)
                    out.append([tree, 1, kind, None, None, None, None, None, None, leaves, k, r.cause, r.value])
                leaves += 1
            else:
                node[4:7] = rows[0].feature, rows[0].bin, rows[0].missing
                todo += [(2 * path + 1, node, 8), (2 * path, node, 7)]
    return spark.createDataFrame([tuple(r) for r in out], grown.schema)


def reshape_bin(x, edges: list[float]):
    """The bin of an encoded feature; null where missing."""
    return F.when(x.isNotNull() & ~F.isnan(x), steps_below(edges, x) if edges else F.lit(0))


class SurvivalForestTV(_Forest):
    """A random survival forest for rows with delayed entry and time-varying features."""

    def predict_cumulative_hazard(self, df: DataFrame, key: list[str], times: list[float] | None = None) -> DataFrame:
        """``key, t, cumhaz`` of fixed profiles, one per row."""
        at = self._sorted(self._times(times))
        what = "survival" if self.aggregate == "survival" else "cumhaz"
        return self._opened(self._predict(df, key, what, at), key, at, "cumhaz")

    def predict_path_hazard(self, df: DataFrame, times: list[float] | None = None, path: str = "id", origin: DataFrame | None = None, extrapolate: str = "none") -> DataFrame:
        """``path, t, cumhaz`` along paths (rows with ``start, stop``) since their origin."""
        routed, origins = self._path(df, path, origin)
        return frames.path_cumulative_hazard(routed, self.leaves, origins, self._times(times), self.n_estimators, path, extrapolate == "locf")

    def predict_survival_function(self, df: DataFrame, key: list[str], times: list[float] | None = None) -> DataFrame:
        return self.predict_cumulative_hazard(df, key, times).withColumn("surv", F.exp(-F.col("cumhaz"))).drop("cumhaz")

    def predict_risk(self, df: DataFrame, key: list[str], horizon: float) -> DataFrame:
        """``key, risk`` of an event by ``horizon``."""
        return self.predict_cumulative_hazard(df, key, [horizon]).select(*key, (1 - F.exp(-F.col("cumhaz"))).alias("risk"))

    predict = _Forest.predict_mortality

    def score(self, cp: CountingProcess) -> float:
        """Concordance of mortality."""
        both = self._outcomes(cp, self.predict_mortality)
        return metrics.defined(metrics.concordance(both.withColumnRenamed("mortality", "risk")), "concordance")

    def _out_of_bag(self) -> None:
        rows = self.oob_rows()
        what = "survival" if self.aggregate == "survival" else "mortality"
        made = self._predict(rows, ["row_key", "id", "start", "stop", "event"], what, self.event_times_, "trees", encoded=True)
        value = F.aggregate("_value", F.lit(0.0), lambda a, x: a + x) if what == "survival" else F.element_at("_value", 1)
        self.oob_prediction_ = made.select("row_key", "id", "start", "stop", "event", value.alias("mortality"), "n_trees").persist()
        used = self.oob_prediction_.where("n_trees > 0")
        if used.isEmpty():
            raise ValidationError("no row is out of any bag; lower max_samples")
        self.oob_score_ = metrics.defined(metrics.concordance(used.withColumnRenamed("mortality", "risk")), "concordance")


class CompetingRisksForestTV(_Forest):
    """A competing-risks forest: split on the causes' log-rank statistics, leaves with cause-specific hazards."""

    defaults = {**_Forest.defaults, "aggregate": "cif", "causes": None, "criterion": "composite", "split_cause": None, "min_events_leaf_cause": None, "score_cause": None}
    aggregates = ("cif", "hazard")

    def _check(self) -> None:
        super()._check()
        if self.criterion != "composite":
            raise ValueError("criterion must be 'composite'")

    def _coded(self, cp: CountingProcess) -> tuple[CountingProcess, list[int]]:
        return frame.encode_causes(cp, self.causes)

    def _place(self, cause: int | None) -> int:
        cause = self.causes_[0] if cause is None else cause
        if cause not in self.causes_:
            raise ValueError(f"cause {cause!r} is not among {self.causes_}")
        return self.causes_.index(cause) + 1

    def _limits(self) -> kernel.Limits:
        out = super()._limits()
        out.min_events_cause = self.min_events_leaf_cause or 0
        out.split_cause = None if self.split_cause is None else self._place(self.split_cause)
        return out

    def predict_incidence(self, df: DataFrame, key: list[str], times: list[float] | None = None) -> DataFrame:
        """``key, t, cause, cif`` and survival as cause 0, of fixed profiles."""
        at = self._sorted(self._times(times))
        made = self._predict(df, key, "cif" if self.aggregate == "cif" else "cif_hazard", at)
        table, labels = F.array(*(F.lit(t) for t in at)), F.array(*(F.lit(c).cast("long") for c in [0, *self.causes_]))
        opened = made.select(*key, F.posexplode("_value").alias("_k", "cif"))
        return opened.select(*key, F.element_at(table, F.col("_k") % len(at) + 1).alias("t"), F.element_at(labels, (F.col("_k") / len(at)).cast("int") + 1).alias("cause"), "cif")

    def predict_cumulative_incidence(self, df: DataFrame, key: list[str], times: list[float] | None = None, cause: int | None = None) -> DataFrame:
        """``key, t, cause, cif`` for one cause, or all."""
        out = self.predict_incidence(df, key, times).where("cause > 0")
        return out if cause is None else out.where(F.col("cause") == self.causes_[self._place(cause) - 1])

    def predict_cumulative_hazard(self, df: DataFrame, key: list[str], times: list[float] | None = None, cause: int | str | None = None) -> DataFrame:
        """``key, t, cause, cumhaz`` per cause, or ``key, t, cumhaz`` of ``cause="all"``."""
        at = self._sorted(self._times(times))
        if cause == "all":
            return self._opened(self._predict(df, key, "cumhaz", at), key, at, "cumhaz")
        made = self._predict(df, key, "cause_cumhaz", at)
        table, labels = F.array(*(F.lit(t) for t in at)), F.array(*(F.lit(c).cast("long") for c in self.causes_))
        opened = made.select(*key, F.posexplode("_value").alias("_k", "cumhaz"))
        out = opened.select(*key, F.element_at(table, F.col("_k") % len(at) + 1).alias("t"), F.element_at(labels, (F.col("_k") / len(at)).cast("int") + 1).alias("cause"), "cumhaz")
        return out if cause is None else out.where(F.col("cause") == self.causes_[self._place(cause) - 1])

    def predict_survival_function(self, df: DataFrame, key: list[str], times: list[float] | None = None) -> DataFrame:
        """``key, t, surv``: the product limit, not the exponential of the hazard."""
        return self.predict_incidence(df, key, times).where("cause = 0").select(*key, "t", F.col("cif").alias("surv"))

    def predict_path_incidence(self, df: DataFrame, times: list[float] | None = None, path: str = "id", origin: DataFrame | None = None, extrapolate: str = "none") -> DataFrame:
        """``path, t, surv, f1``... along paths since their origin."""
        routed, origins = self._path(df, path, origin)
        return frames.path_cumulative_incidence(routed, self.leaves, origins, self._times(times), self.n_estimators, len(self.causes_), path, extrapolate == "locf", self.aggregate)

    def predict(self, df: DataFrame, key: list[str]) -> DataFrame:
        """``key, risk``: the incidence of ``score_cause`` at the last event time."""
        cause = self.causes_[self._place(self.score_cause) - 1]
        return self.predict_cumulative_incidence(df, key, [self.event_times_[-1]], cause).select(*key, F.col("cif").alias("risk"))

    def predict_risk(self, df: DataFrame, key: list[str], horizon: float, cause: int | None = None) -> DataFrame:
        cause = self.causes_[self._place(cause) - 1]
        return self.predict_cumulative_incidence(df, key, [horizon], cause).select(*key, F.col("cif").alias("risk"))

    def score(self, cp: CountingProcess) -> float:
        """Concordance for ``score_cause``, with competing events as non-cases."""
        cause = self.causes_[self._place(self.score_cause) - 1]
        both = self._outcomes(cp, self.predict)
        return metrics.defined(metrics.concordance_competing(both, cause), "concordance")

    def _out_of_bag(self) -> None:
        rows = self.oob_rows()
        place = self._place(self.score_cause)
        made = self._predict(rows, ["row_key", "id", "start", "stop", "event"], "cif" if self.aggregate == "cif" else "cif_hazard", [self.event_times_[-1]], "trees", encoded=True)
        self.oob_prediction_ = made.select("row_key", "id", "start", "stop", "event", F.element_at("_value", place + 1).alias("risk"), "n_trees").persist()
        used = self.oob_prediction_.where("n_trees > 0")
        if used.isEmpty():
            raise ValidationError("no row is out of any bag; lower max_samples")
        self.oob_score_ = metrics.defined(metrics.concordance_competing(used, place), "concordance")
