"""Numbers and sums over a table's order against plain ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazardframe.forest import frames
from hazardframe.frame import unit_codes
from hazardframe.functions import clock_cell, hash31, hash_cell, numbered, running_sum
from hazardframe.operators import resample


def edge_values():
    rnd = random.Random(1)
    around = [s * 2.0**e * f for e in range(-40, 70, 3) for s in (1, -1) for f in (1 - 2**-53, 1.0, 1 + 2**-52, 1.3)]
    return [0.0, math.inf, -math.inf, math.nan, 5e-324, 1e308, 1e9, 1e9 + 1, *around, *(rnd.uniform(-1e4, 1e4) for _ in range(300))]


def test_cells_follow_the_order_of_numbers(spark):
    values = edge_values()
    rows = spark.createDataFrame([(v,) for v in values], "t double").select("t", clock_cell(F.col("t")).alias("c")).collect()
    cells = [r.c for r in sorted(rows, key=lambda r: (math.isnan(r.t), 0 if math.isnan(r.t) else r.t))]
    assert cells == sorted(cells)
    assert max(cells) - min(cells) < 200_000


def test_cells_of_whole_numbers_and_null(spark):
    rows = spark.range(-5000, 5000).select("id", clock_cell(F.col("id")).alias("c")).orderBy("id").collect()
    assert [r.c for r in rows] == sorted(r.c for r in rows) and len({r.c for r in rows}) > 5000
    least = spark.range(1).select(clock_cell(F.lit(None).cast("long")).alias("c")).first().c
    assert least < min(r.c for r in rows)
    assert spark.range(1).select(clock_cell(F.lit(-(1 << 63)).cast("long")).alias("c")).first().c <= rows[0].c


def test_cells_of_hashes(spark):
    rows = spark.createDataFrame([(0,), (1,), (2**30,), (2**31 - 2,)], "h long").select(hash_cell(F.col("h")).alias("c")).collect()
    assert [r.c for r in rows] == [0, 0, 2048, 4095]


@pytest.mark.parametrize("n", [0, 1, 300])
def test_numbers_and_running_sums(spark, n):
    rnd = random.Random(n)
    values = sorted({rnd.choice([rnd.uniform(-5, 5), rnd.uniform(0, 1e6)]) for _ in range(n)})
    df = spark.createDataFrame([(v, k + 1) for k, v in enumerate(values)], "t double, d long").repartition(3)
    got = numbered(running_sum(df, "upto", "d", "t"), "k", ["t"], clock_cell(F.col("t"))).orderBy("t").collect()
    assert [(r.t, r.k) for r in got] == [(v, k) for k, v in enumerate(values)]
    assert [r.upto for r in got] == [(k + 1) * (k + 2) // 2 for k in range(len(values))]


@pytest.mark.parametrize("n_draw", [1, 7, 158, 250, 400])
def test_bags_hold_the_units_of_the_least_hash(spark, n_draw):
    units = spark.range(250).withColumnRenamed("id", "unit")
    got = frames.draw_bags(units, "unit", 3, n_draw, 11).collect()
    hashes = units.crossJoin(spark.range(3).select(F.col("id").alias("tree"))).select("tree", "unit", hash31(F.lit(11), F.col("tree"), F.col("unit")).alias("h")).collect()
    want = {(t, u) for t in range(3) for _, u in sorted((r.h, r.unit) for r in hashes if r.tree == t)[:n_draw]}
    assert {(r.tree, r.unit) for r in got} == want and len(got) == len(want) and {r.copies for r in got} == {1}


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([(f"u{i % 40}", f"k{i:03d}") for i in range(100)] + [(None, "k999")], "id string, key string")
    drawn = resample.bootstrap_ids(df, "id", 3, 2).groupBy("rep").count().collect()
    assert sorted((r.rep, r["count"]) for r in drawn) == [(0, 41), (1, 41)]
    codes = {r.id: r.unit_code for r in unit_codes(df, "id", "key").select("id", "unit_code").distinct().collect()}
    assert codes == {f"u{i}": i for i in range(40)}


def test_no_task_orders_a_whole_table(spark):
    """Windows in one task take cells, never the ids themselves."""
    plan = resample.group_folds(spark.range(1000), "id", 3, 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("], ", 1)[1] for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_cell#" in w for w in windows)
