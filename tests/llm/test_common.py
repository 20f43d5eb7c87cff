"""Joins with frequent keys, folders that are removed, tasks of small tables."""

import random

import pytest

from hazardframe.llm import common


@pytest.mark.parametrize(("frequent", "most"), [(10_000, 50_000), (3, 50_000), (3, 4), (0, 1 << 40)])
def test_joined_evenly(spark, monkeypatch, frequent, most):
    monkeypatch.setattr(common, "FREQUENT", frequent)
    monkeypatch.setattr(common, "MOST_FREQUENT", most)
    rnd = random.Random(frequent)
    rows = [(rnd.choice([1, 1, 1, 2, 3, 4, 5, None]), rnd.choice([7, 8]), i) for i in range(200)]
    count = {}
    for a, b, _ in rows:
        count[a, b] = count.get((a, b), 0) + 1
    table = [(a, b, n, f"v{a}{b}") for (a, b), n in count.items() if a is not None and (a, b) != (4, 7)] + [(9, 9, 5, "none")]
    want = sorted((a, b, i, f"v{a}{b}") for a, b, i in rows if a is not None and (a, b) != (4, 7))
    left = spark.createDataFrame(rows, "a long, b long, i long")
    right = spark.createDataFrame(table, "a long, b long, n long, v string")
    got = common.joined_evenly(left, right, ["a", "b"], "n", ["v"], ["i"])
    assert got.columns == ["a", "b", "i", "v"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in common.joined_evenly(left, right, ["a", "b"], "n", [], ["i"]).collect()) == [w[:3] for w in want]
    assert common.joined_evenly(left, right.limit(0), ["a", "b"], "n", ["v"], ["i"]).count() == 0


def test_scratch_is_removed(spark):
    fs, shared = common._place(spark, common.shared_dir(spark))
    names = lambda: {s.getPath().getName() for s in fs.listStatus(shared)} if fs.exists(shared) else set()
    before = names()
    with common.scratch(spark):
        assert common.stored(spark.range(5), "inside").count() == 5
        assert len(names() - before) == 1
    assert names() == before


def test_small_tables_are_spread(spark):
    n = spark.sparkContext.defaultParallelism
    assert common.partitions(common.spread(spark.range(100).coalesce(1))) == n
    assert common.partitions(common.spread(spark.range(0, 100, 1, n + 3))) == n + 3
