"""Near-duplicates by SimHash fingerprints and BK-trees.

Two 64-bit fingerprints that differ in at most 4 bits agree wholly in one of five
blocks of bits, so every distinct fingerprint goes to five shards, one per block
and value, and all links lie inside shards. A task reads a shard's fingerprints in
order and grows a BK-tree of them: children are keyed by their Hamming distance to
the parent, and a search follows only the edges whose distance lies within the
radius of the distance to the node. The links found are joined at once into local
components, so a shard gives one link a fingerprint and never all pairs.

A shard of more fingerprints than a task should hold is not searched but dealt
again: its free bits are cut into five blocks, by the same argument. A shard's
size is thus known before its tree is made, and what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import arrow_schema, gathered, joined_evenly, map_rows, partitions, spread, stored, text_of, type_of, unused
from hazardframe.llm.components import components

WIDTH, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Fingerprints of a shard that are searched, by how often the shard was dealt.
LIMITS = (256, 8192, 8192, 8192)
FULL = (1 << BITS) - 1


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the runs of ``width`` words, or of all words where they are fewer; words are cut at ASCII white space, A-Z in lower case."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    span = min(width, len(words)) - 1
    ends, digest = stop[span:].tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends, strict=False)), dtype="<u8", count=len(ends))


def simhash(text: str, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned number; zero for a text without words."""
    return majority(shingles(text, width))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of ``hashes`` (unsigned 64-bit, little-endian)."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, hashes.size, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > hashes.size, bitorder="little").tobytes(), "little")


class BKTree:
    """Numbers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def near(self, x: int, radius: int = RADIUS) -> Iterator[int]:
        """The numbers of the tree within ``radius`` of ``x``, one after another."""
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                yield value
            if children:
                todo += [child for key, child in children.items() if d - radius <= key <= d + radius]

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        value, children = self.root
        while d := (x ^ value).bit_count():
            if d not in children:
                children[d] = (x, {})
                return
            value, children = children[d]


def local_components(numbers: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(number, least of its component) for numbers that are not the least themselves."""
    tree, parent = BKTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in numbers:
        parent[x] = x
        for y in tree.near(x, radius):
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(x)
    return [(x, root) for x in numbers if (root := find(x)) != x]


def block_masks(mask: int, blocks: int = RADIUS + 1) -> list[int]:
    """``mask`` with one more block of its free bits each; too few free bits make fewer blocks."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _searched(rows: DataFrame, limit: int) -> DataFrame:
    """(mask, shard, number, root): links of searched shards, and with a null root rows of shards dealt again."""
    schema = "mask bigint, shard bigint, number bigint, root bigint"
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[int] = []
        current, deal = None, []

        def dealt(x: int) -> list[tuple]:
            return [(_signed(m), _signed(x & m), _signed(x), None) for m in deal]

        def close() -> list[tuple]:
            if len(held) < 2:
                return []
            return [(*current, _signed(x), _signed(r)) for x, r in local_components(held)]

        for batch in batches:
            for mask, shard, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (mask, shard) != current:
                    out += close()
                    current, held, deal = (mask, shard), [], []
                x = number & FULL
                if deal:
                    out += dealt(x)
                else:
                    held.append(x)
                    if len(held) > limit:
                        deal = block_masks(mask & FULL)
                        out += [row for y in held for row in dealt(y)]
                        held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=target)
                out = []
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=target)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "mask", "shard").sortWithinPartitions("mask", "shard", "number").mapInArrow(run, schema)


def near_links(numbers: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """Links (u, v) that connect all of the distinct ``number`` (bigint) that differ in at most 4 bits.

    Not every pair: of the numbers of a shard each is linked to the least one that
    it is connected to. The last limit's shards have three blocks in common at
    least and are searched at any size.
    """
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks(0)))
    rows = numbers.select(F.explode(masks).alias("mask"), "number").select("mask", F.col("mask").bitwiseAND(F.col("number")).alias("shard"), "number")
    links = None
    for k, limit in enumerate(limits):
        last = k + 1 == len(limits)
        out = stored(_searched(rows, 1 << 62 if last else limit), "shards", int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = out.where("root is not null").select(F.col("number").alias("u"), F.col("root").alias("v"))
        links = found if links is None else links.unionAll(found)
        rows = out.where("root is null").select("mask", "shard", "number")
        if last or rows.isEmpty():
            break
    return links


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, number, text_hash) of every row; ``number`` is the fingerprint as a signed long."""

    def kernel(ids, hashes, texts):
        return {id_col: ids, "number": [_signed(simhash(t)) for t in texts], "text_hash": hashes}

    text = text_of(text_col)
    return map_rows(spread(docs.select(id_col, F.xxhash64(text).alias("_hash"), text.alias("_text"))), f"`{id_col}` {type_of(docs, id_col)}, number bigint, text_hash bigint", kernel)


def roots(prints: DataFrame, id_col: str) -> DataFrame:
    """(number, root) for the distinct numbers of ``prints``; root is the least number of the component."""
    numbers = prints.select("number").distinct()
    found = components(near_links(numbers))
    return numbers.join(found.withColumnRenamed("node", "number"), "number", "left").select("number", F.coalesce("root", "number").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint``, ``component_id``.

    Fingerprints that differ in at most 4 bits are linked; the component's id is
    the least id of any document reachable. A null or empty text has fingerprint
    zero and is linked like any other. Null ids never name a component, unless
    it has no other; repeated rows are one another's copies; an empty table gives
    an empty one; a very long text counts with all its shingles. Documents with
    equal fingerprints count once in the search. Further columns are never read.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints", partitions(docs))
    first = prints.groupBy("number").agg(F.min(id_col).alias("_first"), F.count("*").alias("rows"))
    known = stored(gathered(first.join(roots(prints, id_col), "number")), "known")
    least = known.groupBy("root").agg(F.min("_first").alias("component_id"), F.count("*").alias("numbers"))
    named = stored(gathered(joined_evenly(known.select("number", "root", "rows"), least, ["root"], "numbers", ["component_id"], ["number"]).drop("root")), "named")
    rows = joined_evenly(prints.select(id_col, "number", "text_hash"), named, ["number"], "rows", ["component_id"], [id_col, "text_hash"])
    return gathered(rows.select(id_col, F.lpad(F.lower(F.hex("number")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the least id, then of the least text hash.

    A component of null ids keeps the row of the least text hash.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints", partitions(docs))
    return one_of_each(docs, prints, roots(prints, id_col), id_col, text_col)


def one_of_each(docs: DataFrame, prints: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that ``keep_one`` keeps; ``prints`` has (id, number, text_hash), ``found`` (number, root)."""
    best = prints.groupBy("number").agg(F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))).alias("best"))
    kept = best.join(found, "number").groupBy("root").agg(F.min("best").alias("best"))
    i, h, own = (unused(docs, x) for x in ("_kept_id", "_kept_hash", "_own_hash"))
    kept = kept.select(F.col("best.i").alias(i), F.col("best.h").alias(h)).distinct()
    rows = docs.withColumn(own, F.xxhash64(text_of(text_col)))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left_semi")
    return gathered(rows.dropDuplicates([id_col, own]).select(*(F.col(f"`{c}`") for c in docs.columns)))
