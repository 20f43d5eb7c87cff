"""Hand-worked cases of estimators, landmark stacks and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.errors import UndefinedMetricError, ValidationError
from hazardframe.frame import CountingProcess
from hazardframe.operators import estimators as est
from hazardframe.operators import landmark as lm
from hazardframe.operators import metrics as mt
from hazardframe.operators import resample

CP = "id long, start double, stop double, event long"


def cp_of(spark, rows):
    return CountingProcess(spark.createDataFrame(rows, CP))


def table(spark, stop, event, risk):
    return spark.createDataFrame([(i, 0.0, float(s), int(e), float(r)) for i, (s, e, r) in enumerate(zip(stop, event, risk, strict=True))], CP + ", risk double")


def test_delayed_entry(spark):
    rows = [(i, float(a), float(z), e) for i, (a, z, e) in enumerate(zip([0, 1, 1, 2, 0], [1, 2, 3, 3, 2], [1, 1, 0, 1, 0], strict=True))]
    out = est.nelson_aalen(cp_of(spark, rows)).orderBy("t").collect()
    assert [r.t for r in out] == [1.0, 2.0, 3.0]
    assert np.allclose(np.diff([0.0, *(r.cumhaz for r in out)]), [1 / 2, 1 / 3, 1 / 2])


def test_aalen_johansen_tiny(spark):
    ids, start = [1, 1, 2, 3, 3, 4, 5, 6, 7], [0, 1, 0.5, 0, 1, 1.2, 0, 0, 0]
    stop, cause = [1, 2, 1.5, 1, 2, 3, 2, 2.5, 3], [0, 1, 2, 0, 2, 1, 0, 1, 0]
    rows = [(i, float(a), float(z), c) for i, a, z, c in zip(ids, start, stop, cause, strict=True)]
    out = {r.t: (r.surv, r.f1, r.f2) for r in est.aalen_johansen(cp_of(spark, rows), [1, 2]).collect()}
    assert np.allclose(out[1.5], (6 / 7, 0, 1 / 7))
    assert all(abs(sum(v) - 1) < 1e-12 for v in out.values())


def test_hazard_of_one(spark):
    rows = [(1, 0.0, 1.0, 1), (2, 0.0, 2.0, 2)]
    out = est.aalen_johansen(cp_of(spark, rows), [1, 2]).orderBy("t").collect()
    assert [r.surv for r in out] == [0.5, 0.0] and out[-1].f1 + out[-1].f2 == 1.0


def test_step_lookup(spark):
    steps = spark.createDataFrame([(1.0, 0.5), (2.0, 0.25)], "t double, v double")
    asked = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 9.0)], "t double")
    at = lambda left: [r.v for r in est.step_lookup(asked, steps, "v", 1.0, left=left).orderBy("t").collect()]
    assert at(False) == [1.0, 0.5, 0.5, 0.25, 0.25] and at(True) == [1.0, 1.0, 0.5, 0.5, 0.25]


def test_landmark_aggregates(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 0, 1.0, -2.0), (1, 1.0, 2.0, 0, None, -1.0), (1, 2.0, 4.0, 1, 5.0, 1.0)], CP + ", z double, m double")
    cp = CountingProcess(df, features=("z",))
    names = ["last", "first", "mean", "min", "max", "sum", "count", "slope", "std"]
    row = lm.landmark_features(cp, 2.0, [("z", n) for n in names]).first()
    assert [row[f"z_{n}"] for n in names[:-1]] == [5.0, 1.0, 3.0, 1.0, 5.0, 6.0, 3.0, 2.0] and abs(row.z_std - math.sqrt(8)) < 1e-12
    timed = CountingProcess(df.withColumn("z", F.coalesce("z", F.lit(3.0))), features=("z",), measured_at="m")
    assert abs(lm.landmark_features(timed, 2.0, [("z", "slope")]).first().z_slope - 9 / 7) < 1e-12
    early = lm.landmark_features(cp, 0.0, [("z", "slope"), ("z", "std")]).first()
    assert early.z_slope is None and early.z_std is None
    with pytest.raises(ValidationError):
        lm.landmark_features(cp, 0.0, ["stop"])
    with pytest.raises(ValidationError):
        lm.landmark_features(cp, 0.0, ["z", "z"])


def test_landmark_risk_sets(spark):
    cp = CountingProcess(spark.createDataFrame([(1, 0.0, 2.0, 1, 1.0), (2, 1.0, 5.0, 0, 2.0), (3, 0.0, 3.0, 2, 3.0)], CP + ", z double"), features=("z",))
    out = lm.landmark_stack(cp, 2.0, ["z"], [0.0, 1.0, 2.0]).orderBy("landmark", "id").collect()
    assert [(r.landmark, r.id, r.stop, r.event) for r in out] == [(0, 1, 2.0, 1), (0, 3, 2.0, 0), (1, 1, 1.0, 1), (1, 2, 2.0, 0), (1, 3, 2.0, 2), (2, 2, 2.0, 0), (2, 3, 1.0, 2)]
    assert [r.id for r in lm.landmark_features(cp, 3.0, ["z"]).orderBy("id").collect()] == [2]
    assert lm.landmark_times(cp, step=2.0) == [0.0, 2.0, 4.0]


def naive_concordance(rows, cause=None):
    num = den = 0.0
    for i, _, t, e, r in rows:
        if e == 0 or (cause and e != cause):
            continue
        for j, a, z, e2, r2 in rows:
            if j != i and a < t <= z and not (e2 and z == t) or cause and e2 and e2 != cause and z <= t and j != i:
                num += (r > r2) + 0.5 * (r == r2)
                den += 1
    return num / den


@pytest.mark.parametrize("ranges", [None, 2, 7])
def test_concordance_against_pairs(spark, ranges):
    rng = np.random.default_rng(3)
    start = rng.integers(0, 4, 60)
    rows = [(int(i), float(a), float(a + d), int(e), float(r)) for i, a, d, e, r in zip(range(60), start, rng.integers(1, 6, 60), rng.integers(0, 3, 60), rng.integers(0, 8, 60), strict=True)]
    df = spark.createDataFrame(rows, CP + ", risk double")
    assert abs(mt.defined(mt.concordance(df, ranges=ranges), "concordance") - naive_concordance(rows)) < 1e-12
    assert abs(mt.defined(mt.concordance_competing(df, 1, ranges=ranges), "concordance") - naive_concordance(rows, 1)) < 1e-12
    with pytest.raises(UndefinedMetricError):
        mt.defined(mt.concordance(df.where("event = 0"), ranges=ranges), "concordance")


@pytest.mark.parametrize("seed", range(6))
def test_earlier_smaller(seed):
    from hazardframe.operators.pairs import earlier_smaller

    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 70))
    order, rank, case, weight = rng.permutation(n), rng.integers(0, 8, n), rng.random(n) < 0.5, rng.random(n)
    got = earlier_smaller(order, rank, case, weight)
    for i in np.flatnonzero(case):
        earlier = ~case & (order < order[i])
        want = weight[earlier & (rank < rank[i])].sum() + weight[earlier & (rank == rank[i])].sum() / 2
        assert abs(got[i] - want) < 1e-12


# fixed values: a competing-risks case with events, a rival event and a censored row at the horizon
BOUNDARY_STOP = [1.0, 1.5, 2.0, 2.0, 2.0, 0.5, 3.0, 1.0]
BOUNDARY_LABEL = [1, 2, 0, 2, 1, 0, 0, 0]


def test_competing_brier_at_the_horizon(spark):
    rows = table(spark, BOUNDARY_STOP, BOUNDARY_LABEL, [0.6, 0.3, 0.2, 0.4, 0.5, 0.9, 0.1, 0.7])
    got = mt.brier(rows, 2.0, cause=1).first()
    assert abs(got.brier - 41 / 350) < 1e-15
    assert (got.n_cases, got.n_competing, got.n_controls, got.n_censored) == (2, 2, 2, 2)
    steps = est.censoring_survival(CountingProcess(rows)).select("t", F.col("g").alias("v"))
    asked = spark.createDataFrame([(t,) for t in (0.5, 1.0, 1.5, 2.0)], "t double")
    held = [r.v for r in est.step_lookup(asked, steps, "v", 1.0).orderBy("t").collect()]
    assert all(abs(a - b) < 1e-12 for a, b in zip(held, [7 / 8, 35 / 48, 35 / 48, 35 / 96], strict=True))


def test_competing_auc_at_the_horizon(spark):
    rows = table(spark, BOUNDARY_STOP, BOUNDARY_LABEL, [0.3, 0.3, 0.35, 0.4, 0.5, 0.9, 0.1, 0.7])
    assert abs(mt.auc_cumulative(rows, 2.0, cause=1).first().auc - 63 / 88) < 1e-15


def test_squared_left_limit_weight(spark):
    rows = table(spark, [1, 1, 2, 3, 3], [1, 0, 1, 0, 0], [0.9, 0.5, 0.2, 0.4, 0.1])
    assert abs(mt.cindex_incident(rows, 2.5).first().concordance - 13 / 17) < 1e-12


def test_control_at_horizon_uses_left_limit(spark):
    rows = table(spark, [2, 2, 0.5, 1], [0, 0, 1, 0], [0.1, 0.1, 0.1, 0.1])
    weights = {r.id: r.weight for r in mt.ipcw(rows, 2.0).collect()}
    assert abs(weights[0] - 1.5) < 1e-12 and weights[3] == 0.0 and weights[2] == 1.0


def test_clipping_and_exact(spark):
    rows = table(spark, [1, 2, 3, 4, 5], [0, 0, 1, 0, 1], [0.5] * 5)
    out = mt.brier(rows, 5.0, g_min=0.9).first()
    assert out.n_clipped == 2 and out.n_censored == 3
    exact = table(spark, [0.5, 3, 3], [1, 0, 0], [0.8, 0.1, 0.3])
    assert {r.weight for r in mt.ipcw(exact, 1.0).collect()} == {1.0}
    curves = exact.withColumn("curve", F.element_at(F.array(F.array(F.lit(0.2), F.lit(0.1)), F.array(F.lit(0.9), F.lit(0.8)), F.array(F.lit(0.7), F.lit(0.6))), F.col("id").cast("int") + 1))
    assert abs(mt.integrated_brier(curves, "curve", [1.0, 2.0]).first().ibs - (0.14 / 3 + 0.21 / 3) / 2) < 1e-12


def test_piecewise_score(spark):
    a, b = 0.3, 0.7
    rows = [(1, 0.0, 0.5, 1), (2, 0.0, 2.0, 1), (3, 0.0, 3.0, 1), (4, -1.0, 0.0, 1), (5, 0.0, 1.0, 0), (6, 1.5, 2.0, 0)]
    df = spark.createDataFrame(rows, CP).withColumn("H", F.array(F.lit(0.0), F.lit(a), F.lit(a + b)))
    out = {r.window: r for r in mt.piecewise_exponential(df, [0.0, 1.0, 2.0], ["H"], [[0.0, 0.5, 1.0]], alpha=0.0, by="window").collect()}
    assert abs(out[0].score - (math.log(a) - 3.5 * a)) < 1e-12 and abs(out[1].score - (math.log(b) - 2.5 * b)) < 1e-12
    zero = df.withColumn("H", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert mt.piecewise_exponential(zero, [0.0, 1.0, 2.0], ["H"], [[0.0, 0.5, 1.0]], alpha=0.0).first().score == -math.inf


def test_rolling_origin(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("t"))
    out = resample.rolling_origin(df, "t", 3, 5.0, 2.0)
    got = {(r.fold, r.role): (r.a, r.z) for r in out.groupBy("fold", "role").agg(F.min("t").alias("a"), F.max("t").alias("z")).collect()}
    assert got == {(0, "train"): (0, 13), (0, "test"): (15, 19), (1, "train"): (0, 18), (1, "test"): (20, 24), (2, "train"): (0, 23), (2, "test"): (25, 29)}


def test_folds_and_donors(spark):
    df = spark.range(50).select(F.col("id").alias("id"), (F.col("id") % 4).alias("s"), (F.col("id") % 7).cast("double").alias("t"))
    folds = resample.group_folds(df, "id", 3)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [16, 17, 17]
    both = resample.group_time_folds(df, "t", "id", 3, 2.0)
    test, train = both.where("role = 'test'"), both.where("role = 'train'")
    assert test.join(train, ["fold", "id"]).count() == 0
    pairs = resample.donors(df, "id", ["s"], 5, 3)
    assert pairs.count() == 150 and pairs.select("repeat", "donor").distinct().count() == 150
    assert pairs.where(F.col("id") % 4 != F.col("donor") % 4).count() == 0
    assert resample.balanced_group_folds([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
