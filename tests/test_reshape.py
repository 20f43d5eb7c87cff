"""Hand-worked cases of validation, adapters and reshaping."""

import math

import pytest
from pyspark.sql import functions as F

from hazardframe import frame
from hazardframe.errors import ValidationError
from hazardframe.frame import CountingProcess
from hazardframe.operators import reshape
from hazardframe.sources import adapters

CP = "id long, start double, stop double, event long"


def cp_of(spark, rows, **roles):
    return CountingProcess(spark.createDataFrame(rows, CP), **roles)


def test_validate(spark):
    good = [(1, 0.0, 1.0, 0), (1, 1.0, 2.0, 1), (2, 0.5, 3.0, 0)]
    frame.validate(cp_of(spark, good))
    for bad, what in [
        ((1, 1.5, 3.0, 0), "overlap"),
        ((2, 3.5, 4.0, 0), "gap"),
        ((3, 2.0, 2.0, 0), "start"),
        ((3, 2.0, math.inf, 0), "finite"),
        ((3, 0.0, 1.0, -1), "label"),
        ((1, 2.0, 3.0, 0), "last row"),
    ]:
        with pytest.raises(ValidationError, match=what):
            frame.validate(cp_of(spark, [*good, bad]))
    frame.validate(cp_of(spark, [*good, (2, 3.5, 4.0, 0)]), gap_policy="split_id")
    frame.validate(cp_of(spark, [*good, (1, 1.5, 3.0, 0)]), layout="stacked")
    with pytest.raises(ValidationError, match="no event"):
        frame.validate(cp_of(spark, good[:1]))
    late = CountingProcess(spark.createDataFrame([(1, 0.0, 1.0, 1, 0.5)], CP + ", m double"), measured_at="m")
    with pytest.raises(ValidationError, match="measured"):
        frame.validate(late)


def test_segments_and_causes(spark):
    rows = [(1, 0.0, 1.0, 0), (1, 1.0, 2.0, 0), (1, 3.0, 4.0, 7), (2, 0.0, 1.0, 3)]
    out = {(r.id, r.start): r.segment for r in frame.split_segments(cp_of(spark, rows)).collect()}
    assert out == {(1, 0.0): 0, (1, 1.0): 0, (1, 3.0): 1, (2, 0.0): 0}
    coded, causes = frame.encode_causes(cp_of(spark, rows))
    assert causes == [3, 7] and {(r.id, r.start): r.event for r in coded.df.collect()}[(1, 3.0)] == 2
    with pytest.raises(ValidationError, match="among"):
        frame.encode_causes(cp_of(spark, rows), [3])


def test_fingerprint_ignores_order(spark):
    rows = [(i, 0.0, float(i + 1), i % 2) for i in range(20)]
    a, b = spark.createDataFrame(rows, CP), spark.createDataFrame(rows[::-1], CP).repartition(3)
    assert frame.fingerprint(a) == frame.fingerprint(b) != frame.fingerprint(a.limit(19))


def test_targets(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2)], "stop double, event int")
    assert [tuple(r) for r in frame.survival_target(df).collect()] == [(0.0, 1.0, True), (0.0, 2.0, None)]
    assert [r.event for r in frame.competing_target(df).collect()] == [1, 2]
    with pytest.raises(TypeError):
        frame.survival_target(df.withColumn("event", F.col("stop")))


def test_encoder(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", float("nan")), (3, None, 3.0)], "id long, c string, x double")
    enc = reshape.CategoryEncoder().fit(df, ["c", "x"])
    assert enc.names == ["c=a", "c=b", "x"] and enc.expand(["c"]) == [0, 1]
    out = {r.id: (r["c=a"], r["c=b"], r.x) for r in enc.transform(df).collect()}
    assert out == {1: (0.0, 1.0, 1.0), 2: (1.0, 0.0, None), 3: (None, None, 3.0)}
    new = spark.createDataFrame([(9, "z", 1.0)], "id long, c string, x double")
    with pytest.raises(ValidationError, match="unseen"):
        enc.transform(new)
    assert enc.transform(new, "missing").first()["c=a"] is None
    coded = reshape.CategoryEncoder(["x"]).fit(spark.createDataFrame([(10.0,), (9.0,)], "x double"), ["x"])
    assert coded.names == ["x=9.0", "x=10.0"]


def test_locf(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, nan), (0, 2.0, 3.0), (1, 0.0, nan), (1, 1.0, 10.0), (1, 2.0, None)], "id long, start double, x double")
    out = [r.x for r in reshape.impute_locf(df, "id", "start", ["x"]).orderBy("id", "start").collect()]
    assert out == [1.0, 1.0, 3.0, None, 10.0, 10.0]


def test_blocks(spark):
    rows = [(0, 0.0, 2.5, 1), (1, 1.0, 2.0, 0), (2, -0.5, 0.5, 1), (3, 2.25, 2.75, 1)]
    out = reshape.split_blocks(cp_of(spark, rows), 1.0).orderBy("id", "start").collect()
    assert [r.id for r in out] == [0, 0, 0, 1, 2, 2, 3]
    assert [r.block for r in out] == [0, 1, 2, 1, -1, 0, 2]
    assert [r.stop for r in out] == [1, 2, 2.5, 2, 0, 0.5, 2.75]
    assert [r.event for r in out] == [0, 0, 1, 0, 0, 1, 1]
    third = reshape.split_blocks(cp_of(spark, [(0, 0.0, 1.0, 1)]), 0.1).orderBy("start").collect()
    assert len(third) == 10 and all(a.stop == b.start for a, b in zip(third, third[1:], strict=False))
    with pytest.raises(Exception, match="blocks"):
        reshape.split_blocks(cp_of(spark, [(0, 0.0, 5000.0, 1)]), 1.0).collect()
    with pytest.raises(Exception, match="exact edges"):
        reshape.split_blocks(cp_of(spark, [(0, 2.0**52, 2.0**52 + 2, 1)]), 1.0).collect()


def test_coarsen(spark):
    rows = [(1, 0.0, 1.0, 0), (1, 1.0, 3.0, 0), (1, 3.0, 3.5, 2), (2, 0.5, 1.5, 1), (3, 0.0, 9.0, 0), (4, 4.5, 5.0, 1)]
    out = reshape.coarsen(cp_of(spark, rows), [2.0, 4.0]).orderBy("id", "start").collect()
    assert [(r.id, r.start, r.stop, r.event) for r in out] == [(1, 0.0, 2.0, 0), (1, 2.0, 4.0, 2), (3, 0.0, 4.0, 0)]
    gone = reshape.coarsen(cp_of(spark, rows), [2.0, 4.0], lost=True).orderBy("id").collect()
    assert [r.id for r in gone] == [2, 4]


@pytest.mark.parametrize("bins", [2, 4, 255])
def test_edges_against_numpy(spark, bins):
    import numpy as np

    rng = np.random.default_rng(bins)
    x = np.round(rng.normal(size=100), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    edges = [r.edge for r in reshape.feature_edges(df, ["x"], bins).orderBy("j").collect()]
    distinct = np.unique(x)
    if distinct.size <= bins:
        want = distinct[:-1] + np.diff(distinct) / 2
    else:
        s = np.sort(x)
        want = np.unique([s[q * 100 // bins] for q in range(1, bins)])
        want = want[want < s[-1]]
    assert edges == want.tolist()
    out = reshape.bin_columns(df, {"x": edges}).collect()
    assert [r.x_bin for r in out] == [int((want < v).sum()) for v in x] + [None, None]


def test_censor_split_exposure(spark):
    cp = cp_of(spark, [(1, 0.0, 2.0, 1), (2, 1.0, 5.0, 1)])
    assert [(r.id, r.stop, r.event) for r in reshape.censor_at(cp, 2.0).orderBy("id").collect()] == [(1, 2.0, 1), (2, 2.0, 0)]
    out = adapters.split_at_time(cp.df, F.lit(1.5), "late").orderBy("id", "start").collect()
    assert [(r.start, r.stop, r.event, r.late) for r in out] == [(0.0, 1.5, 0, False), (1.5, 2.0, 1, True), (1.0, 1.5, 0, False), (1.5, 5.0, 1, True)]
    cells = reshape.exposures(cp, [0.0, 1.0, 3.0]).orderBy("id", "m").collect()
    assert [(r.id, r.m, r.exposure) for r in cells] == [(1, 0, 1.0), (1, 1, 1.0), (2, 1, 2.0)]


def test_quantile_codes(spark):
    code = lambda xs, n: [r.code for r in reshape.quantile_codes(spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double"), "x", n).orderBy("i").collect()]
    assert code([1, 2, 3, 4], 2) == [0, 0, 1, 1]
    assert code([1, 2, 2, 3, 9], 2) == [0, 0, 0, 1, 1]
    assert code([5, 7, 5], 4) == [0, 1, 0]


def test_wide_and_repair(spark):
    wide = spark.createDataFrame([(1, 4, 1, "a", "a", "b", "b", "c"), (2, 2, 0, "x", None, "y", "y", "y")], "id long, w int, arrest int, p0 string, p1 string, p2 string, p3 string, p4 string")
    out = adapters.from_wide_periods(wide, "id", "w", "arrest", ["p0", "p1", "p2", "p3", "p4"], "job").orderBy("id", "start").collect()
    assert [(r.id, r.start, r.stop, r.event, r.job) for r in out] == [(1, 0.0, 2.0, 0, "a"), (1, 2.0, 4.0, 1, "b"), (2, 0.0, 1.0, 0, "x"), (2, 1.0, 2.0, 0, None)]
    messy = spark.createDataFrame([(1, 0.0, 3.0, 0), (1, 2.0, 5.0, 1), (1, 5.0, 7.0, 0), (2, 0.0, 1.0, 0)], CP)
    fixed = adapters.repair_overlaps(messy).orderBy("id", "start").collect()
    assert [(r.id, r.start, r.stop, r.event) for r in fixed] == [(1, 0.0, 3.0, 0), (1, 3.0, 5.0, 1), (2, 0.0, 1.0, 0)]


def test_noise_is_reproducible(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    a = {r.k: r.noise for r in reshape.noise_column(df, "k", 1).collect()}
    b = {r.k: r.noise for r in reshape.noise_column(df.repartition(7), "k", 1).collect()}
    mean = sum(a.values()) / 4000
    assert a == b and abs(mean) < 0.06 and abs(sum((x - mean) ** 2 for x in a.values()) / 4000 - 1) < 0.1


def test_long_lookups_and_sketched_edges(spark):
    import numpy as np

    from hazardframe.functions import steps_below

    points = [float(x) for x in range(0, 20_000, 2)]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.0, 9_999.5, 1e9, None)], "x double")
    for inclusive, side in ((False, "left"), (True, "right")):
        got = [r.n for r in df.select(steps_below(points, F.col("x"), inclusive).alias("n")).collect()]
        assert got == [int(np.searchsorted(points, v, side)) for v in (-1.0, 0.0, 1.0, 2.0, 9_999.5, 1e9)] + [0]
    wide = spark.range(10_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    edges = {}
    for r in reshape.approximate_edges(wide, ["x", "y"], 4).collect():
        edges.setdefault(r.feature, []).append(r.edge)
    assert edges["y"] == [0.0, 1.0] and np.allclose(sorted(edges["x"]), [2500, 5000, 7500], atol=10)
