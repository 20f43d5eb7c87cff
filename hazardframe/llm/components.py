"""Connected components of a link table.

A table of at most ``SMALL`` links is solved by one task; a larger one by rounds
of alternating large and small stars, which stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_schema, stored

#: Links that one task may hold (some tens of MB).
SMALL = 1 << 18


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node around each node.

    Large star: every larger neighbour goes to the least of the node and its
    neighbours. Small star: the node and its smaller neighbours do.
    """
    around = _both_ways(links) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = around.join(least, "u")
    if large:
        hung = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        hung = joined.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        hung = hung.unionAll(least.where(F.col("u") != F.col("low")).select("u", F.col("low").alias("v")))
    return hung.where(F.col("u") != F.col("v")).distinct()


def _in_one_task(links: DataFrame) -> DataFrame:
    """(node, root) by union and find."""
    schema = "node bigint, root bigint"
    target = arrow_schema(links.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array([find(x) for x in nodes], type=pa.int64())], schema=target)

    return links.coalesce(1).mapInArrow(run, schema)


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v, both bigint): root is its component's least node.

    The links are read more than once. Nodes and components of a large table stay distributed; each round is
    written to the shared folder. Rounds grow with the logarithm of the longest
    chain, not with its length. A table without links gives an empty one.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = links.where("u != v").select("u", "v")
    if now.count() <= small:
        return stored(_in_one_task(now), "components")
    was, seen = None, state(now)
    while seen != was:
        now = stored(_star(_star(now, large=True), large=False), "links")
        was, seen = seen, state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
