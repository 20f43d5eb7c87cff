"""Folds over time and groups, permutations within strata, and resampled ids.

All randomness is a hash of a key and a seed, so it does not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazardframe.functions import hash31, hash_cell, numbered, value_cell


def fold_windows(times: DataFrame, time: str, n_splits: int, test_size: float) -> list[tuple[int, float, float]]:
    """(fold, lo, hi) of test windows ``(lo, hi]`` stacked back from the last time."""
    end = float(times.agg(F.max(time)).first()[0])
    return [(k, end - (n_splits - k) * test_size, end - (n_splits - 1 - k) * test_size) for k in range(n_splits)]


def rolling_origin(df: DataFrame, time: str, n_splits: int, test_size: float, gap: float = 0.0) -> DataFrame:
    """Rows with ``fold`` and ``role`` (train or test): a fold trains on times up to its first test time less ``gap``.

    Rows are opened into the folds they belong to; the fold table is small and broadcast.
    """
    windows = fold_windows(df, time, n_splits, test_size)
    spark = df.sparkSession
    table = spark.createDataFrame(windows, "fold int, lo double, hi double")
    inside = (F.col(time) > F.col("lo")) & (F.col(time) <= F.col("hi"))
    first = df.select(time).join(F.broadcast(table), inside).groupBy("fold").agg(F.min(time).alias("first"))
    folds = table.join(first, "fold")
    rows = df.join(F.broadcast(folds), inside | (F.col(time) <= F.col("first") - gap))
    return rows.withColumn("role", F.when(inside, "test").otherwise("train")).drop("lo", "hi", "first")


def group_folds(df: DataFrame, group: str, n_splits: int, seed: int = 0) -> DataFrame:
    """``group, fold``: folds of nearly equal numbers of groups, by rank of a hash of the group."""
    h = hash31(F.lit(seed), F.col(group))
    groups = numbered(df.select(group).distinct(), "_n", [h, group], hash_cell(h))
    return groups.select(group, F.pmod("_n", F.lit(n_splits)).cast("int").alias("fold"))


def balanced_group_folds(sizes: list[tuple[object, int]], n_splits: int) -> dict[object, int]:
    """Greedy folds of groups by size: the largest group goes to the lightest fold."""
    load, out = [0] * n_splits, {}
    for group, n in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        fold = load.index(min(load))
        out[group] = fold
        load[fold] += n
    return out


def group_time_folds(df: DataFrame, time: str, group: str, n_splits: int, test_size: float, gap: float = 0.0, seed: int = 0) -> DataFrame:
    """Time windows crossed with group folds: tests hold one fold's groups, training none of them.

    ``fold`` numbers window * n_splits + group fold.
    """
    marked = df.join(group_folds(df, group, n_splits, seed).withColumnRenamed("fold", "_g"), group)
    rows = rolling_origin(marked, time, n_splits, test_size, gap).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    own = F.col("_g") == F.col("_k")
    rows = rows.where(F.when(F.col("role") == "test", own).otherwise(~own))
    return rows.withColumn("fold", (F.col("fold") * n_splits + F.col("_k")).cast("int")).drop("_g", "_k")


def donors(df: DataFrame, key: str, strata: list[str], seed: int, repeats: int = 1) -> DataFrame:
    """``repeat, key, donor``: a permutation of the keys within strata, per repeat.

    Ranks by key meet ranks by a hash of the key; all repeats are one plan.
    """
    rows = df.select(key, *strata).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    place = Window.partitionBy("repeat", *strata)
    shuffled = hash31(F.lit(seed), F.col("repeat"), F.col(key))
    left = rows.withColumn("_r", F.row_number().over(place.orderBy(key)))
    right = rows.select("repeat", *strata, F.col(key).alias("donor"), F.row_number().over(place.orderBy(shuffled, key)).alias("_r"))
    return left.join(right, ["repeat", *strata, "_r"]).select("repeat", key, "donor")


def singleton_rows(df: DataFrame, strata: list[str]) -> DataFrame:
    """``n``: rows that are alone in their stratum and so cannot be permuted."""
    return df.groupBy(*strata).count().where("count = 1").agg(F.count("*").alias("n"))


def bootstrap_ids(df: DataFrame, id: str, seed: int, n: int) -> DataFrame:
    """``rep, draw, id``: ids drawn with replacement, as many as there are, in each of ``n`` repetitions.

    Draws take ids by their number, in the order of numeric ids and of a hash of others.
    """
    ids = df.select(id).distinct()
    cell, follows = value_cell(ids, id)
    every = numbered(ids, "_n", [id] if follows else [F.xxhash64(id), id], cell)
    total = ids.agg(F.count("*").alias("_total"))
    slots = every.select(F.col("_n").alias("draw")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    slots = slots.crossJoin(F.broadcast(total)).withColumn("_n", hash31(F.lit(seed), F.col("rep"), F.col("draw")) % F.col("_total"))  # one row
    return slots.join(every, "_n").select("rep", "draw", id)
