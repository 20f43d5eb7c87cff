"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are the broadcast side; their size is checked, and a larger set is
taken in blocks of bounded size, each against all documents. A block takes two
scans of the documents. The first counts how often each of the items' word 3-grams
occurs in the corpus; the counts are summed by task before they are shuffled. Of
every two adjacent 3-grams of an item the rarer in the corpus becomes a seed (of
equals that of fewer items). The second scan joins texts and items on the seeds
alone. Seeds of one item at about the same offset make a place; a place goes on if
enough of the item's words are there, whatever their order, and there the item is
aligned: first word by word without gaps, then, where that does not reach the
threshold, by Smith-Waterman with free replaced and dropped words.

A copy that keeps at least 0.8 of an item of 16 words or more has four unchanged
words in a row, which are two adjacent 3-grams and so hold a seed. Of shorter items
every 3-gram is a seed, and of items of four or five words also the outer two words
on both sides of one place, so a copy of any length from three words on is found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import SLICE, arrow_schema, gathered, spread, text_of, type_of, unused

GRAM = 3
#: Items of fewer words have all their 3-grams as seeds.
SHORT = 16
SIMILAR = 0.8
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
#: Bytes of test items that are broadcast at once.
BLOCK = 8 << 20
#: Words that are aligned at once; of longer items the parts' alignments are added up.
PASSAGE = 1024
#: Places of items in a text that are looked at together.
PLACES = 1 << 19
#: Cells of alignments that are filled together.
CELLS = 1 << 20
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def opened(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``at``, index) for all indexes of the ranges ``first[at]`` to ``first[at + 1]``."""
    size = first[at + 1] - first[at]
    which = np.repeat(np.arange(at.size), size)
    return which, np.arange(which.size) - np.repeat(np.cumsum(size) - size, size) + first[at][which]


class Items:
    """Test items as numbers of words, in units of at most ``PASSAGE`` words, with an index of their 3-grams."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        self.known: dict[str, int] = {}
        self.units: list[np.ndarray] = []
        item_of, lengths = [], []
        for i, text in enumerate(texts):
            words = np.array([self.known.setdefault(w, len(self.known)) for w in words_of(text)], dtype=np.int64)
            lengths.append(words.size)
            for part in np.array_split(words, max(1, math.ceil(words.size / PASSAGE))):
                self.units.append(part)
                item_of.append(i)
        self.item_of = np.array(item_of, dtype=np.int64)
        self.item_size = np.array(lengths, dtype=np.int64)
        self.size = np.array([x.size for x in self.units], dtype=np.int64)
        self.alone = self.size == self.item_size[self.item_of] if self.units else np.zeros(0, bool)
        self.slack = np.ceil(self.size * (1 / SIMILAR - 1)).astype(np.int64) + 2
        #: Words a place must have; the parts of a longer item are judged together.
        self.needed = np.where(self.alone, np.ceil(SIMILAR * self.size - 1e-9), 1).astype(np.int64)
        bags = [np.unique(x, return_counts=True) for x in self.units]
        none = np.zeros(0, dtype=np.int64)
        self.bag_first = np.cumsum([0, *(w.size for w, _ in bags)])
        self.bag_word, self.bag_count = (np.concatenate([none, *(b[k] for b in bags)]) for k in (0, 1))
        self.keys, self.first, self.unit_at, self.offset_at = self._index([grams(x) for x in self.units])
        self.skips, self.skip_first, self.skip_unit, self.skip_offset = self._index([skip_of(x) for x in self.units])

    @staticmethod
    def _index(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, and for each the units and offsets that have it."""
        none = np.zeros(0, dtype=np.int64)
        key = np.concatenate([none, *found])
        unit = np.repeat(np.arange(len(found)), [x.size for x in found])
        offset = np.concatenate([none, *(np.arange(x.size) for x in found)])
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        return keys, np.append(first, key.size), unit[order], offset[order]

    def numbers(self, text: str) -> np.ndarray:
        get = self.known.get
        words = words_of(text)
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def seeds(self, counts: np.ndarray) -> np.ndarray:
        """Which 3-grams are seeds; see the module."""
        chosen = np.zeros(self.keys.size, dtype=bool)
        owners = np.diff(self.first)
        for x in self.units:
            of = np.searchsorted(self.keys, grams(x))
            if x.size < SHORT:
                chosen[of] = True
                continue
            a, b = of[:-1], of[1:]
            rarer = (counts[a] < counts[b]) | ((counts[a] == counts[b]) & (owners[a] <= owners[b]))
            chosen[np.where(rarer, a, b)] = True
        return chosen


class Search:
    """Finds the items of a block in texts, from places with a seed on."""

    def __init__(self, items: Items, seeds: np.ndarray, whole: bool):
        self.items, self.seeds, self.whole = items, np.flatnonzero(seeds), whole
        self.keys = items.keys[self.seeds]

    def places(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(unit, offset, first word, end) of where units could lie, in arrays of bounded length."""
        it = self.items
        position, at = lookup(self.keys, grams(numbers))
        which, index = opened(it.first, self.seeds[at])
        found = [(it.unit_at[index], position[which] - it.offset_at[index])] if which.size <= PLACES else None
        if found is None:  # a few positions at a time; a copy lies inside the place of each of its seeds
            del which, index
            cut = np.cumsum(it.first[self.seeds[at] + 1] - it.first[self.seeds[at]]) // PLACES
            found = self._pieces(position, at, cut)
        if it.skips.size:
            position, at = lookup(it.skips, skips(numbers))
            which, index = opened(it.skip_first, at)
            found = [*found, (it.skip_unit[index], position[which] - it.skip_offset[index])]
        for unit, offset in found:
            order = np.lexsort((offset, unit))
            unit, offset = unit[order], offset[order]
            if not unit.size:
                continue
            slack, size = it.slack[unit], it.size[unit]
            new = np.append(True, (np.diff(unit) != 0) | (np.diff(offset) > slack[1:]))
            begin = offset[new][np.cumsum(new) - 1]
            span = (offset - begin) // (4 * (size + slack))  # a long run of places is cut
            new[1:] |= np.diff(span) != 0
            first = np.flatnonzero(new)
            last = np.append(first[1:], unit.size) - 1
            u, low = unit[first], offset[first]
            yield u, low, np.maximum(0, low - slack[first]), np.minimum(numbers.size, offset[last] + size[first] + slack[first])

    def _pieces(self, position: np.ndarray, at: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in np.unique(cut):
            some = cut == k
            which, index = opened(self.items.first, self.seeds[at[some]])
            yield self.items.unit_at[index], position[some][which] - self.items.offset_at[index]

    def covered(self, numbers: np.ndarray, unit: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """How many of a unit's words are between ``a`` and ``z``, whatever their order."""
        it = self.items
        out = np.zeros(unit.size, dtype=np.int64)
        windows, inverse = np.unique(a * (numbers.size + 1) + z, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        cuts = np.append(np.searchsorted(inverse[order], np.arange(windows.size)), unit.size)
        for k in range(windows.size):
            some = order[cuts[k] : cuts[k + 1]]
            word, have = np.unique(numbers[a[some[0]] : z[some[0]]], return_counts=True)
            if not word.size:
                continue
            which, index = opened(it.bag_first, unit[some])
            near = np.minimum(np.searchsorted(word, it.bag_word[index]), word.size - 1)
            both = np.where(word[near] == it.bag_word[index], np.minimum(have[near], it.bag_count[index]), 0)
            out[some] = np.bincount(which, both, minlength=some.size).astype(np.int64)
        return out

    def __call__(self, numbers: np.ndarray) -> list[tuple]:
        """(item, similarity, matches, first word, end) of the items that the text holds."""
        it = self.items
        best: dict[int, tuple] = {}
        parts: dict[int, list[tuple]] = {}
        for unit, low, a, z in self.places(numbers):
            cover = self.covered(numbers, unit, a, z)
            some = np.flatnonzero(cover >= it.needed[unit])
            for u, row in self._aligned(numbers, *(x[some] for x in (unit, low, a, z)), it.alone[unit[some]]):
                if row[0] >= SIMILAR and row[0] > best.get(int(it.item_of[u]), (0,))[0]:
                    best[int(it.item_of[u])] = row
            for k in some[~it.alone[unit[some]]].tolist():
                parts.setdefault(int(it.item_of[unit[k]]), []).append((int(unit[k]), int(cover[k]), int(low[k]), int(a[k]), int(z[k])))
        for item, places in parts.items():
            if row := self._long(numbers, item, places):
                best[item] = row
        return [(i, *row) for i, row in sorted(best.items())]

    def _aligned(self, numbers, unit, low, a, z, use) -> Iterator[tuple[int, tuple]]:
        """(unit, row) of the places in ``use``."""
        unit, low, a, z = (x[use] for x in (unit, low, a, z))
        if not self.whole:
            for u, x, y in zip(unit.tolist(), a.tolist(), z.tolist(), strict=True):
                similar, matches, i, j = align(self.items.units[u], numbers[x:y])
                yield u, (similar, matches, x + i, x + j)
            return
        # places of equal shape are aligned together
        shape = np.stack([self.items.size[unit], low, a, z], axis=1)
        shapes, inverse = np.unique(shape, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        cuts = np.append(np.searchsorted(inverse.ravel()[order], np.arange(len(shapes))), unit.size)
        for k, (size, at, x, y) in enumerate(shapes.tolist()):
            same = unit[order[cuts[k] : cuts[k + 1]]]
            step = max(1, CELLS // max(1, size, y - x))
            for part in (same[i : i + step] for i in range(0, same.size, step)):
                yield from self._shaped(numbers, part, size, at, x, y)

    def _shaped(self, numbers, units, size, at, x, y) -> Iterator[tuple[int, tuple]]:
        words = np.stack([self.items.units[u] for u in units.tolist()])
        here = np.arange(at, at + size)
        inside = (here >= 0) & (here < numbers.size)
        line = np.where(inside, numbers[np.clip(here, 0, numbers.size - 1)], -1)
        kept = words == line
        n = kept.sum(axis=1)
        good = n >= SIMILAR * size - 1e-9
        first, last = kept.argmax(axis=1), size - kept[:, ::-1].argmax(axis=1)
        for i in np.flatnonzero(good).tolist():
            yield int(units[i]), (int(n[i]) / size, int(n[i]), at + int(first[i]), at + int(last[i]))
        rest = np.flatnonzero(~good)
        if rest.size:
            for i, row in zip(rest.tolist(), zip(*align_many(words[rest], numbers[x:y]), strict=True), strict=True):
                yield int(units[i]), (row[0], row[1], x + row[2], x + row[3])

    def _long(self, numbers, item: int, places: list[tuple]) -> tuple | None:
        """The row of an item of several units, if they together keep enough of its words."""
        size, cover = int(self.items.item_size[item]), {}
        for u, n, *_ in places:
            cover[u] = max(cover.get(u, 0), n)
        if sum(cover.values()) < SIMILAR * size - 1e-9:
            return None
        best: dict[int, tuple] = {}
        for u, _, low, a, z in places:
            one = (np.array([v]) for v in (u, low, a, z))
            for _, row in self._aligned(numbers, *one, np.ones(1, bool)):
                if row[1] and row[0] > best.get(u, (0,))[0]:
                    best[u] = row
        matches = sum(row[1] for row in best.values())
        inserted = sum(round(row[1] / row[0]) - int(self.items.size[u]) for u, row in best.items())
        similar = matches / (size + inserted)
        if similar < SIMILAR:
            return None
        return similar, matches, min(row[2] for row in best.values()), max(row[3] for row in best.values())


def lookup(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, places in ``keys``) of those of ``found`` that are there."""
    if not found.size or not keys.size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.flatnonzero(found >= 0)
    at = np.minimum(np.searchsorted(keys, found[inside]), keys.size - 1)
    same = keys[at] == found[inside]
    return inside[same], at[same]


def grams(numbers: np.ndarray) -> np.ndarray:
    """A key for each run of three words; negative where a word is unknown."""
    if numbers.size < GRAM:
        return np.zeros(0, dtype=np.int64)
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    known = (a >= 0) & (b >= 0) & (c >= 0)
    return np.where(known, (a << 42) | (b << 21) | c, -1)


def skips(numbers: np.ndarray) -> np.ndarray:
    """A key for each two words, one that is not looked at, and two words; negative where one is unknown."""
    if numbers.size < 5:
        return np.zeros(0, dtype=np.int64)
    a, b, c, d = numbers[:-4], numbers[1:-3], numbers[3:-1], numbers[4:]
    known = (a >= 0) & (b >= 0) & (c >= 0) & (d >= 0)
    left, right = ((a << 21) | b).astype(np.uint64), ((c << 21) | d).astype(np.uint64)
    mixed = (left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(1)
    return np.where(known, mixed.astype(np.int64), -1)


def skip_of(unit: np.ndarray) -> np.ndarray:
    """The key of :func:`skips` that a copy of a unit has whose middle is replaced (five words) or parted (four)."""
    if unit.size not in (4, 5):
        return np.zeros(0, dtype=np.int64)
    return skips(np.concatenate([unit[:2], unit[:1], unit[-2:]]))


def align(item: np.ndarray, part: np.ndarray) -> tuple[float, int, int, int]:
    """(similarity, matches, first word, end) of the best local alignment of ``item`` in ``part``.

    Similarity is the share of matches in the item's words and what is inserted
    between them.
    """
    n, m = item.size, part.size
    if not n or not m:
        return 0.0, 0, 0, 0
    came = np.zeros((n + 1, m + 1), dtype=np.uint8)  # 1 from both before, 2 from the item's, 3 from the part's word before
    above, ramp = np.zeros(m + 1), -GAP * np.arange(m + 1)
    top, i, j = 0.0, 0, 0
    for k in range(1, n + 1):
        both = np.where(part == item[k - 1], MATCH, MISMATCH) + above[:-1]
        skip = above[1:] + GAP
        row = np.zeros(m + 1)
        row[1:] = np.maximum(np.maximum(both, skip), 0)
        row = np.maximum.accumulate(row + ramp) - ramp
        came[k, 1:] = np.select([row[1:] <= 0, row[1:] == both, row[1:] == skip], [0, 1, 2], 3)
        if row.max() > top:
            top, i, j = float(row.max()), k, int(row.argmax())
        above = row
    end, matches, inserted = j, 0, 0
    while came[i, j]:
        if came[i, j] == 1:
            matches += bool(part[j - 1] == item[i - 1])
            i, j = i - 1, j - 1
        elif came[i, j] == 2:
            i -= 1
        else:
            inserted += 1
            j -= 1
    return matches / (n + inserted), matches, j, end


def align_many(items: np.ndarray, part: np.ndarray) -> tuple[list, list, list, list]:
    """Similarities, matches, first words and ends of alignments of all of each row of ``items`` in ``part``.

    Kept words count 1, inserted ones cost ``SIMILAR`` and replaced or dropped ones
    nothing, so the best score reaches ``SIMILAR`` times the item's words where any
    alignment has that similarity. As no score is below zero, the alignment may
    begin and end anywhere. The words run from the first kept one to the last.
    """
    k, n = items.shape
    m = part.size
    gain, cost = 5, 4  # 1 and SIMILAR in whole numbers
    column = np.arange(m + 1)
    score, matches, inserted, first, last = (np.zeros((k, m + 1), dtype=np.int64) for _ in range(5))
    for i in range(n):
        same = part == items[:, i : i + 1]
        both, skip = score[:, :-1] + gain * same, score[:, 1:]
        take = both >= skip
        kept = take & same
        begun = matches[:, :-1] > 0
        now = [np.where(take, x[:, :-1], x[:, 1:]) for x in (matches, inserted, first, last)]
        now[2] = np.where(kept & ~begun, column[:-1], now[2])
        now[1] = np.where(kept & ~begun, 0, now[1])
        now[3] = np.where(kept, column[1:], now[3])
        now[0] = now[0] + kept
        flow = np.concatenate([score[:, :1], np.where(take, both, skip)], axis=1) + cost * column
        top = np.maximum.accumulate(flow, axis=1)
        source = np.maximum.accumulate(np.where(flow == top, column, 0), axis=1)
        score = top - cost * column
        matches, inserted, first, last = (np.take_along_axis(np.concatenate([old[:, :1], x], axis=1), source, axis=1) for old, x in zip((matches, inserted, first, last), now, strict=True))
        inserted = inserted + column - source
    at = (np.arange(k), score.argmax(axis=1))
    matches, inserted = matches[at], inserted[at]
    return (matches / np.maximum(1, n + inserted)).tolist(), matches.tolist(), first[at].tolist(), np.maximum(first[at], last[at]).tolist()


def align_whole(item: np.ndarray, part: np.ndarray) -> tuple[float, int, int, int]:
    """(similarity, matches, first word, end) of an alignment of all of ``item`` in ``part``; see :func:`align_many`."""
    return tuple(x[0] for x in align_many(item[None], part))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, bound: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about ``bound`` bytes; a block is the only thing that is collected."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / bound))
    for k in range(n if size else 0):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        if part:
            yield [r.i for r in part], [r.t for r in part]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bound: int = BLOCK, whole: bool = False
) -> DataFrame:
    """One row per document row and test item that it holds at a similarity of 0.8 or more.

    Returns id, ``text_hash``, ``item_id``, ``similarity``, ``matches`` and the
    words ``word_start`` to ``word_end`` of the alignment. That alignment is local
    and may stop short of edits near an item's ends; with ``whole`` all of the item
    is aligned, so every copy that keeps 0.8 of the item's words is reported. An
    item of more than ``PASSAGE`` words is aligned in parts whose matches are added
    up, wherever each lies. Items of fewer than three words, null ones among them,
    have no 3-gram and match nothing; equal items are each reported; of places that
    tie the first counts; a null or empty text holds nothing; a very long text is
    searched whole; repeated rows are each reported; empty tables give an empty
    one. Further columns are never read, whatever their names.
    """
    spark = docs.sparkSession
    kind, item_kind = type_of(docs, id_col), type_of(benchmark, item_col)
    rows = spread(docs.select(id_col, F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("_text")))
    schema = f"`{id_col}` {kind}, text_hash bigint, item_id {item_kind}, similarity double, matches bigint, word_start bigint, word_end bigint"
    result = spark.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark, item_col, item_text_col, bound):
        items = Items(ids, texts)
        shared = spark.sparkContext.broadcast(items)
        found = rows.select("_text").mapInArrow(_count(shared, arrow_schema(spark, "gram int, n bigint")), "gram int, n bigint")
        summed = found.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(items.keys.size, dtype=np.int64)
        counts[summed.column("gram").to_numpy()] = summed.column("n").to_numpy()
        seeds = spark.sparkContext.broadcast(items.seeds(counts))
        result = result.unionAll(rows.mapInArrow(_search(shared, seeds, arrow_schema(spark, schema), whole), schema))
    return result


def _count(shared, target: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        counts = np.zeros(items.keys.size, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.slice(at, SLICE).column(0).to_pylist():
                    np.add.at(counts, lookup(items.keys, grams(items.numbers(text)))[1], 1)
        some = np.flatnonzero(counts)
        if some.size:
            yield _rows(list(zip(some.tolist(), counts[some].tolist(), strict=True)), target)

    return run


def _search(shared, seeds, target: pa.Schema, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, seeds.value, whole)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = []
                for doc, digest, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    out += [(doc, digest, search.items.ids[i], *row) for i, *row in search(search.items.numbers(text))]
                if out:
                    yield _rows(out, target)

    return run


def _rows(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, unchanged.

    Null and empty texts hold none and stay; null ids are told apart by their
    texts; of repeated rows all stay or go; empty tables change nothing. Further
    columns pass through, whatever their names.
    """
    i, h = unused(docs, "_leak_id"), unused(docs, "_leak_hash")
    leaks = find_leaks(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias(i), F.col("text_hash").alias(h)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_of(text_col)) == F.col(h))
    return gathered(docs.join(leaks, same, "left_anti"))
