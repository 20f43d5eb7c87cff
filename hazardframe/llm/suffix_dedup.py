"""Exact substring dedup over a corpus, by induced suffix sorting of shards.

Each text's 200-byte windows are labelled by the least hash of their 32-byte
grams. Equal windows have equal labels, so a maximal run of windows with one
label (a stretch of text) can only repeat windows of stretches with that label,
and labels deal the corpus into shards that need nothing from one another.

A label that one stretch alone has is dropped, unless its gram occurs there twice.
Labels and contents are counted by aggregates that are summed before they are
shuffled, and joined back in joins that broadcast the frequent keys, whose number
their counts bound, and scatter the rows that have them.
Stretches with the same label and the same bytes repeat all their windows; one of
them goes on for the others. Where a label has stretches with different bytes,
their bytes are fetched and the suffix array of a shard of labels is built by
:mod:`suffix_array`. A label with more different bytes than a shard may hold, such
as that of a passage in very many contexts, is not gathered at all: its windows are
counted by their 128-bit hashes instead, again summed before they are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import SLICE, arrow_schema, gathered, joined_evenly, map_rows, spread, stored, text_of, type_of
from hazardframe.llm.suffix_array import SpanHash, repeated_positions, short_runs

DEPTH = 200
#: Bytes of a shard (the last label of one may exceed it), of a task's shards, and
#: of a label's different stretches beyond which its windows are counted instead.
SHARD, TASK, HOT = 1 << 20, 16 << 20, 2 << 20
#: Tasks that share the rows of a frequent window.
SALTS = 16


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by running minima from both ends of blocks."""
    size = -(-values.size // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: values.size] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = values.size - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(raw: bytes, depth: int, twice: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """(first window, windows, label) of the runs of windows with one label, and if asked whether its gram occurs twice there."""
    gram = max(1, min(32, depth // 4))
    if len(raw) < depth:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, []
    symbols = np.frombuffer(raw, dtype=np.uint8)
    h = SpanHash(symbols).every(gram)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    label = sliding_least(h, depth - gram + 1)
    first = np.append(0, np.flatnonzero(label[1:] != label[:-1]) + 1)
    windows = np.diff(first, append=label.size)
    ends = (first + windows + depth - gram).tolist()
    again = [np.count_nonzero(h[a:z] == v) > 1 for a, z, v in zip(first.tolist(), ends, label[first], strict=True)] if twice else []
    return first, windows, label[first].view(np.int64), again


def contents_of(raw: bytes, first: np.ndarray, windows: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the bytes of each stretch."""
    ends = (first + windows + depth - 1).tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(first.tolist(), ends, strict=True)], dtype=np.uint64).view(np.int64)


def _labels(docs: DataFrame, depth: int) -> DataFrame:
    """(label, n, several): labels of several stretches, or of one in which its gram occurs twice."""

    def kernel(texts):
        out: dict[str, list] = {"label": [], "content": [], "twice": []}
        for text in texts:
            raw = text.encode()
            first, windows, label, twice = stretches(raw, depth, twice=True)
            out["label"].append(label)
            out["content"].append(contents_of(raw, first, windows, depth))
            out["twice"] += twice
        return {k: np.concatenate(v) if k != "twice" else v for k, v in out.items()}

    rows = map_rows(docs.select("_text"), "label bigint, content bigint, twice boolean", kernel)
    counted = rows.groupBy("label").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("several"), F.max("twice").alias("twice"))
    return counted.where("n > 1 or twice").select("label", "n", "several")


def _cut(docs: DataFrame, id_col: str, depth: int) -> DataFrame:
    def kernel(ids, hashes, texts):
        out: dict[str, list] = {"id": [], "text_hash": [], "first": [], "windows": [], "label": [], "content": []}
        for doc, digest, text in zip(ids, hashes, texts, strict=True):
            raw = text.encode()
            first, windows, label, _ = stretches(raw, depth)
            out["id"] += [doc] * first.size
            out["text_hash"] += [digest] * first.size
            out["first"].append(first)
            out["windows"].append(windows)
            out["label"].append(label)
            out["content"].append(contents_of(raw, first, windows, depth))
        for name in ("first", "windows", "label", "content"):
            out[name] = np.concatenate(out[name])
        return {id_col if k == "id" else k: v for k, v in out.items()}

    schema = f"`{id_col}` {type_of(docs, id_col)}, text_hash bigint, first int, windows int, label bigint, content bigint"
    return map_rows(docs, schema, kernel)


def _judged(rows: DataFrame, id_col: str, depth: int, shard: int) -> DataFrame:
    """(id, text_hash, start, stop) of what repeats in the lone stretches of sorted (label, bytes) rows."""
    schema = f"`{id_col}` {type_of(rows, id_col)}, text_hash bigint, start int, stop int"
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, label = 0, None

        def judge() -> pa.RecordBatch:
            out = []
            for (doc, digest, first, lone, _), marked in zip(held, repeated_positions([h[4] for h in held], depth), strict=True):
                if lone:
                    edges = np.flatnonzero(np.diff(marked, prepend=False, append=False)).tolist()
                    out += [(doc, digest, first + a, first + z - 1 + depth) for a, z in zip(edges[::2], edges[1::2], strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for at_label, *row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    if at_label != label and size >= shard:
                        yield judge()
                        held, size = [], 0
                    label = at_label
                    held.append(tuple(row))
                    size += len(row[4])
        if held:
            yield judge()

    return rows.mapInArrow(run, schema)


def _fetched(keyed: DataFrame, wanted: DataFrame, id_col: str, depth: int) -> DataFrame:
    """The bytes of ``wanted`` stretches: (label, id, text_hash, first, lone, bytes)."""
    by_text = wanted.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("first", "windows", "label", "lone")).alias("_wanted"))
    with_text = keyed.join(by_text, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))

    def fetch(ids, hashes, texts, lists):
        out: dict[str, list] = {"label": [], id_col: [], "text_hash": [], "first": [], "lone": [], "bytes": []}
        for doc, digest, text, found in zip(ids, hashes, texts, lists, strict=True):
            raw = text.encode()
            for s in found:
                out["label"].append(s["label"])
                out[id_col].append(doc)
                out["text_hash"].append(digest)
                out["first"].append(s["first"])
                out["lone"].append(s["lone"])
                out["bytes"].append(raw[s["first"] : s["first"] + s["windows"] + depth - 1])
        return out

    schema = f"label bigint, `{id_col}` {type_of(keyed, id_col)}, text_hash bigint, first int, lone boolean, bytes binary"
    return map_rows(with_text.select(id_col, "text_hash", "_text", "_wanted"), schema, fetch)


def window_ranges(raw: bytes, depth: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of every window, equal ones at the head of a long run of one byte as one range."""
    kept = short_runs(np.frombuffer(raw, dtype=np.uint8), 2 * depth)
    if kept is None:
        yield from ((k, k + depth) for k in range(len(raw) - depth + 1))
        return
    before = -1
    for k in kept.tolist():
        if k > before + 1:
            yield before + 1, k - 1 + depth
        if k <= len(raw) - depth:
            yield k, k + depth
        before = k


def _counted(pieces: DataFrame, id_col: str, depth: int) -> DataFrame:
    """What :func:`_judged` gives, one span a window, by counting the windows' hashes."""

    def opened(labels, ids, hashes, firsts, lones, raws):
        out: dict[str, list] = {"h1": [], "h2": [], id_col: [], "text_hash": [], "start": [], "stop": [], "lone": []}
        for doc, digest, first, lone, raw in zip(ids, hashes, firsts, lones, raws, strict=True):
            for a, z in window_ranges(raw, depth):
                h = xxhash.xxh3_128_intdigest(raw[a : a + depth])
                out["h1"].append((h >> 64) - (1 << 63))
                out["h2"].append((h & (1 << 64) - 1) - (1 << 63))
                out[id_col].append(doc)
                out["text_hash"].append(digest)
                out["start"].append(first + a)
                out["stop"].append(first + z)
                out["lone"].append(lone)
        return out

    schema = f"h1 bigint, h2 bigint, `{id_col}` {type_of(pieces, id_col)}, text_hash bigint, start int, stop int, lone boolean"
    windows = map_rows(pieces, schema, opened)
    # the rows of a frequent window are scattered over SALTS tasks, each of which gets all repeated windows of its share
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("text_hash", "start"), F.lit(SALTS)).cast("int")
    found = windows.where("lone").withColumn("salt", salt).join(twice, ["h1", "h2", "salt"], "left_semi")
    return found.select(id_col, "text_hash", "start", "stop")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(id, text_hash, spans): byte ranges covered by strings of ``depth`` bytes that start anywhere else, too.

    One row per id and text that has any; the ranges may overlap.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of(text_col)
    keyed = spread(docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), text.alias("_text")))
    labels = stored(gathered(_labels(keyed, depth)), "labels")
    places = stored(gathered(joined_evenly(_cut(keyed, id_col, depth), labels, ["label"], "n", ["several"], ["text_hash", "first"])), "stretches")
    contents = places.groupBy("label", "content").agg(F.count("*").alias("copies"), F.min(F.struct(id_col, "text_hash", "first", "windows")).alias("one"), F.max("several").alias("several"))
    copied = stored(gathered(contents.where("copies > 1").select("label", "content", "copies")), "copied")
    whole = joined_evenly(places, copied, ["label", "content"], "copies", [], ["text_hash", "first"])
    spans = whole.select(id_col, "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (depth - 1)).alias("stop"))
    # a label of one stretch is there because its gram occurs twice; else several contents
    # are sorted, one of each; only the windows of those that occur once are still to be judged
    differing = contents.where("several or copies = 1").select("one.*", "label", (F.col("copies") == 1).alias("lone"))
    differing = stored(gathered(differing), "differing")
    sizes = differing.groupBy("label").agg(F.sum(F.col("windows").cast("long") + depth).alias("bytes"))
    size, largest = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    # all in one plan: the texts are then shuffled once for the pieces of both kinds and for what is cut out of them
    if largest and largest > hot:
        common = sizes.where(F.col("bytes") > hot).select("label")
        pieces = _fetched(keyed, differing.join(common, "label", "left_semi"), id_col, depth)
        spans = spans.unionAll(_counted(pieces, id_col, depth))
        differing = differing.join(common, "label", "left_anti")
    if size:
        pieces = _fetched(keyed, differing, id_col, depth)
        dealt = pieces.repartition(max(n, math.ceil(size / TASK)), "label").sortWithinPartitions("label")
        spans = spans.unionAll(_judged(dealt, id_col, depth, shard))
    return spans.groupBy(id_col, "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as maximal ones, in order."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` with what repeats in the corpus removed from the text.

    Returns id, ``n_bytes``, ``removed`` (maximal removed byte ranges) and
    ``kept`` (the other bytes concatenated; cuts may fall inside a character). A
    null text counts as empty; texts shorter than ``depth`` bytes keep all;
    repeated rows repeat one another, and of strings that tie none is spared; a
    very long text is searched whole, a run of one byte in it at the cost of two
    windows; null ids are told apart by their texts; an empty table gives an empty
    one. Further columns are never read, whatever their names.
    """
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    spans = repeated_spans(docs, id_col, text_col, depth, shard, hot).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_text_hash"), "spans")
    both = keyed.join(spans, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash")), "left")

    def kernel(ids, texts, found):
        raws = [t.encode() for t in texts]
        removed = [merged([(s["start"], s["stop"]) for s in x or ()]) for x in found]
        kept = []
        for raw, runs in zip(raws, removed, strict=True):
            at, out = 0, []
            for a, z in runs:
                out.append(raw[at:a])
                at = z
            kept.append(b"".join([*out, raw[at:]]))
        return {id_col: ids, "n_bytes": [len(r) for r in raws], "removed": [[{"start": a, "stop": z} for a, z in x] for x in removed], "kept": kept}

    schema = f"`{id_col}` {type_of(docs, id_col)}, n_bytes bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary"
    return map_rows(gathered(both.select(id_col, "_text", "spans")), schema, kernel)


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Counts and digests of what :func:`remove_repeats` does, one row per document."""

    def kernel(ids, sizes, removed, kept):
        return {
            id_col: ids,
            "n_bytes": sizes,
            "n_removed": [sum(s["stop"] - s["start"] for s in x) for x in removed],
            "n_spans": [len(x) for x in removed],
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }

    schema = f"`{id_col}` {type_of(docs, id_col)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return map_rows(remove_repeats(docs, id_col, text_col, depth, shard, hot), schema, kernel)
