"""Near-duplicates by SimHash fingerprints and BK-trees, at any similarity from 0.8 of the shingle sets.

This is the general form of :mod:`simhash`: shingles of five words, a wide radius
and an exact check. Texts are near copies where the sets of their runs of five
words have a Jaccard similarity of 0.8 or more, and a component is what such links
connect. Documents of equal sets are one node.

At a similarity of 0.8 two 64-bit fingerprints differ in 9.7 bits on average, far
too many for blocks of equal bits to deal them into shards. A node therefore goes
to 24 shards, each named by four of 96 min-wise hashes: two nodes of similarity 0.8
share no shard with a probability of 3.2e-6, of 0.85 with one of 8e-9. Nodes that
share a shard are only candidates: a star a shard connects them into groups, and a
group's sets are then brought together once. There each shard holds its nodes in
BK-trees of their fingerprints, one tree for each component found so far. A node
searches a shard's trees within 24 bits, follows only the edges within that radius,
and leaves a tree at the first number whose set is similar by the exact count; then
it belongs to that tree's component. Fingerprints of similarity 0.8 differ in more
than 24 bits with a probability of 3e-06 (1e-04 for a set of five shingles against four
of them); of unrelated ones 97 of 100 do. Components are those of the verified
links alone.

A group of more shingles than a task should hold is dealt to slots, and every two
slots meet in a task of their own, so all its candidate pairs are still compared;
each text of such a group is sent once a slot. A group of more slots than a node
has shards is not held together: each of its shards is judged on its own, and only
a shard of too many shingles is dealt to slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_schema, map_rows, partitions, spread, stored, text_of, type_of
from hazardframe.llm.components import components
from hazardframe.llm.simhash import BKTree, majority, one_of_each, shingles

WORDS, SIMILAR = 5, 0.8
#: Differing bits of the fingerprints of candidates; see the module.
RADIUS = 24
BANDS, ROWS = 24, 4
#: Shingles of a slot of a group (8 bytes each); a task holds two slots.
HELD = 1 << 22
_DRAWN = np.random.default_rng(11).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
_MASKS, _ODD = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, width: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; 64-bit hashes stand for the shingles."""
    return np.unique(shingles(text, width))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed number per band; a set without shingles has those of an empty one."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, hashes.size, 1 << 10):
        part = (hashes[at : at + (1 << 10), None] ^ _MASKS) * _ODD
        np.minimum(low, part.min(axis=0), out=low)
    digest, raw = xxhash.xxh64_intdigest, low.astype("<u8").tobytes()
    made = [digest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)]
    return np.array(made, dtype=np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two ordered sets have a Jaccard similarity of ``least`` or more."""
    if min(a.size, b.size) < least * max(a.size, b.size) - 1e-9:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= least * (a.size + b.size - both) - 1e-9


class Shard:
    """The nodes of one component in one shard: a BK-tree of fingerprints, and the nodes that have each."""

    def __init__(self, node: int, number: int):
        self.tree, self.nodes, self.any = BKTree(), {number: [node]}, node
        self.tree.add(number)

    def near(self, number: int, radius: int) -> Iterator[int]:
        for found in self.tree.near(number, radius):
            yield from self.nodes[found]

    def absorb(self, other: Shard) -> None:
        for number, nodes in other.nodes.items():
            if number not in self.nodes:
                self.tree.add(number)
            self.nodes.setdefault(number, []).extend(nodes)


def verified(nodes: list[tuple[int, np.ndarray]], least: float = SIMILAR, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (u, v) that connect what the similar pairs among those that share a shard connect."""
    parent: dict[int, int] = {}
    sets = dict(nodes)
    #: For each shard its nodes, by component.
    shards: dict[tuple[int, int], list[Shard]] = {}
    links = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, held in sets.items():
        parent[x] = x
        number = majority(held)
        tried: set[int] = set()
        for place in enumerate(bands(held)):
            parts: dict[int, Shard] = {}
            for part in shards.get(place, ()):
                root = find(part.any)
                if root in parts:
                    small, large = sorted((parts[root], part), key=lambda p: len(p.nodes))
                    large.absorb(small)
                    part = large
                parts[root] = part
            for root, part in parts.items():
                if find(x) == find(root):
                    continue
                for y in part.near(number, radius):
                    if y not in tried:
                        tried.add(y)
                        if similar(held, sets[y], least):
                            links.append((x, y))
                            parent[find(x)] = find(y)
                            break
            own = next((p for root, p in parts.items() if find(root) == find(x)), None)
            if own:
                own.absorb(Shard(x, number))
            shards[place] = [*parts.values(), *([] if own else [Shard(x, number)])]
    return links


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """(id, number, text_hash, size, bands) of every row; ``number`` stands for the set of its shingles."""

    def kernel(ids, hashes, texts):
        sets = [shingle_set(t, width) for t in texts]
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        return {id_col: ids, "number": keys, "text_hash": hashes, "size": [s.size for s in sets], "bands": [bands(s) for s in sets]}

    text = text_of(text_col)
    rows = spread(docs.select(id_col, F.xxhash64(text).alias("_hash"), text.alias("_text")))
    return map_rows(rows, f"`{id_col}` {type_of(docs, id_col)}, number bigint, text_hash bigint, size bigint, bands array<bigint>", kernel)


def near_links(docs: DataFrame, prints: DataFrame, text_col: str = "text", width: int = WORDS, least: float = SIMILAR, held: int = HELD, shards: int = BANDS) -> DataFrame:
    """Links (u, v) of distinct ``number`` of ``prints`` whose sets are similar; they connect all that such links connect."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = prints.groupBy("number").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    cells = nodes.select("number", F.explode("bands").alias("band"))
    centres = cells.groupBy("band").agg(F.min("number").alias("v"), F.max("number").alias("most")).where("v < most").select("band", "v")
    stars = cells.join(centres, "band").where(F.col("number") != F.col("v")).select(F.col("number").alias("u"), "v").distinct()
    groups = stored(components(stored(stars, "candidates", n)), "groups", n)

    chosen = nodes.select("number", "text_hash", "size", "bands").join(groups.withColumnRenamed("node", "number"), "number")
    dealt = F.greatest(F.ceil(F.sum("size") / held).cast("int"), F.lit(1)).alias("slots")
    by_group = chosen.join(chosen.groupBy("root").agg(dealt), "root")
    few = by_group.where(F.col("slots") <= shards).select(F.col("root").alias("key"), "slots", "number", "text_hash")
    large = by_group.where(F.col("slots") > shards).select(F.explode("bands").alias("key"), "number", "text_hash", "size")
    several = large.groupBy("key").agg(dealt, F.count("*").alias("nodes")).where("nodes > 1").drop("nodes")
    many = large.join(several, "key").select("key", "slots", "number", "text_hash")
    slot, other = F.pmod(F.xxhash64("number"), F.col("slots")).cast("int"), lambda j: F.struct(F.least(F.col("slot"), j).alias("a"), F.greatest(F.col("slot"), j).alias("b"))
    placed = few.unionAll(many).withColumn("slot", slot).select("key", "number", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), other)).alias("pair"))
    # one text of each wanted hash, before it is dealt to the slots
    wanted = chosen.select("text_hash").distinct()
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text")).join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    rows = placed.join(texts, "text_hash").select("key", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "number", "text")
    schema = "u bigint, v bigint"
    target = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(group) > 1 and (found := verified(group, least)):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)], schema=target)

        for batch in batches:
            keys, firsts, seconds, numbers, found = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                if (at := (keys[i].as_py(), firsts[i].as_py(), seconds[i].as_py())) != current:
                    yield from close()
                    current, group = at, []
                group.append((numbers[i].as_py(), shingle_set(found[i].as_py(), width)))
        yield from close()

    return stored(rows.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "number").mapInArrow(run, schema), "verified", n)


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, least: float = SIMILAR, held: int = HELD, shards: int = BANDS) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one of the least id, then of the least text hash.

    A component of null ids keeps the row of the least text hash. Texts without
    words, null ones among them, are one another's copies; a text of fewer words
    than ``width`` is one shingle; repeated rows are kept once; ties of the least
    id are broken by the text's hash, and equal rows are one; an empty table stays
    empty; a very long text counts with all its shingles. Further columns pass
    through, whatever their names. Shards and radius are made for a ``least`` of
    0.8 or more.
    """
    prints = stored(sketches(docs, id_col, text_col, width), "sketches", partitions(docs))
    found = components(near_links(docs, prints, text_col, width, least, held, shards)).withColumnRenamed("node", "number")
    named = prints.select("number").distinct().join(found, "number", "left").select("number", F.coalesce("root", "number").alias("root"))
    return one_of_each(docs, prints, named, id_col, text_col)
