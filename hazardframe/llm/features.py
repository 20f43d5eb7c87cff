"""Hashed text features and the bounded labelled sample that classifiers learn from."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import map_rows, stored, text_of

#: Features are hashed to this many places; a model keeps only those it selects.
SPACE = 1 << 24
#: Words whose features a task remembers; the memory is emptied when full.
REMEMBERED = 100_000

MARKS = string.punctuation
#: Letters that stand for a word's stem.
STEM = 5
#: Share of a text's words from which a stem counts as frequent in it, a feature of its own.
DENSE = 0.01
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")


#: Kinds of features start the hash apart.
WORD_KIND, SHAPE_KIND, STEM_KIND, STATISTIC_KIND, METADATA_KIND = 1, 2, 3, 4, 5
#: Words beyond this length are looked at anew each time and not remembered.
LONG = 64
#: Features (of all sampled rows together) that are sent to the driver; 8 bytes each.
ENTRIES = 1 << 24


def _slot(kind: int, name: str) -> int:
    return zlib.crc32(name.encode(), kind) % SPACE


class Extractor:
    """Features of a text: its words, their shapes and stems, and binned statistics of its structure."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int]] = {}
        self.shapes: dict[str, int] = {}

    def _word(self, word: str) -> tuple[int, int, int]:
        """Slots of the word, its shape, and its first letters (-1 if it has no more)."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        core = word.strip(MARKS)
        letter = "A" if word.isupper() else "a"
        if len(core) == len(word) and core.isalpha():
            shape = letter
        elif core.isalpha():
            at = word.find(core)
            shape = f"{word[:at]}{letter}{word[at + len(core) :]}"
        else:
            shape = DIGITS.sub("9", LETTERS.sub(letter, word))
        if (place := self.shapes.get(shape)) is None:
            place = _slot(SHAPE_KIND, shape)
            if len(shape) <= LONG:
                if len(self.shapes) >= REMEMBERED:
                    self.shapes.clear()
                self.shapes[shape] = place
        core = core.lower()
        found = (_slot(WORD_KIND, core), place, _slot(STEM_KIND, core[:STEM]) if len(core) > STEM else -1)
        if len(word) <= LONG:
            self.known[word] = found
        return found

    def __call__(self, text: str, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(slots ascending, how often each occurs); statistics count once.

        ``length`` is what the table says of the text's length, as far as it is known.
        """
        words = text.split()
        distinct = Counter(words)
        known, new = self.known.get, self._word
        found = np.array([known(w) or new(w) for w in distinct], dtype=np.int64).reshape(-1, 3)
        times = np.fromiter(distinct.values(), dtype=np.float64, count=len(distinct))
        stems, n = _summed(found[:, 2], times)
        if stems.size and stems[0] < 0:
            stems, n = stems[1:], n[1:]
        often = n >= max(2, DENSE * len(words))
        single = np.array([_slot(STATISTIC_KIND, f"{name}:{value}") for name, value in statistics(text, words, distinct).items()], dtype=np.int64)
        if length is not None:
            single = np.append(single, _slot(METADATA_KIND, f"length:{int(np.log2(1 + max(0, length)))}"))
        slots = np.concatenate([found[:, 0], found[:, 1], stems, (stems[often] * 31 + 7) % SPACE, single])
        counts = np.concatenate([times, times, n, n[often], np.ones(single.size)])
        slots, counts = _summed(slots, counts)
        return slots, counts.astype(np.float32)


def _summed(slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots, ascending, with the sums of their counts."""
    if not slots.size:
        return slots, counts
    order = np.argsort(slots)
    slots = slots[order]
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    return slots[first], np.add.reduceat(counts[order], first)


def statistics(text: str, words: list[str], distinct: Counter[str]) -> dict[str, int]:
    """Structure of a text, each figure in a few bins."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256)
    size, n = max(1, raw.size), max(1, len(words))
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    plain = seen[[33, 39, 44, 46, 58, 59, 63]].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b, bins=20: int(bins * min(1.0, a / max(1, b)))
    return {
        "chars": int(np.log2(1 + raw.size)),
        "words": int(np.log2(1 + len(words))),
        "word_length": min(20, int(sum(map(len, words)) / n)),
        "upper": share(upper, upper + lower),
        "digits": share(digits, size, 40),
        "marks": share(marks, size, 40),
        "odd_marks": share(marks - plain, n),
        "spaces": share(seen[32], size),
        "other_bytes": share(seen[128:].sum(), size, 10),
        "distinct_words": share(len(distinct), n),
        "lines": int(np.log2(1 + len(lines))),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "words_a_line": min(12, int(np.log2(1 + n / max(1, len(lines))))),
        "longest_word": min(12, int(np.log2(1 + max(map(len, distinct), default=0)))),
        "top_word": share(max(distinct.values(), default=0), n),
    }


@cache
def extractor() -> Extractor:
    """One per process, so that tasks share what it remembers."""
    return Extractor()


def held_out(id_col: str):
    """Rows that no model learns from: CRC-32 of the id as text leaves 2 by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def length_of(docs: DataFrame, length_col: str | None):
    """The length that the table states, as a long; null where it has no such column."""
    known = length_col in docs.columns
    return (F.col(length_col).cast("long") if known else F.lit(None).cast("long")).alias("_length")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, marks: list[str], bound: int, least: int, most: int, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, entries: int = ENTRIES
) -> list[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """At most ``bound`` labelled documents as (marks, slots, counts), in order of a hash of the id.

    The sample holds the labelled rows that come first by that hash, is the same
    for the same tables, and leaves out the held-out rows. Labels that are null
    are left out; of a repeated id the largest label and the smallest text count.
    Only slots of at least ``least`` sampled documents are kept, the ``most``
    commonest; they are counted by Spark before anything is collected. What is
    broadcast is bounded by ``bound``, what is collected by ``most`` and by
    ``entries`` slots of all rows: rows beyond these are left out.
    """
    spark = docs.sparkSession
    some = (
        labels.where(F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(*(F.max(m).cast("int").alias(f"_mark{i}") for i, m in enumerate(marks)))
        .dropna()
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(bound)
    )
    names = [f"_mark{i}" for i in range(len(marks))]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = (
        docs.select(F.col(id_col), text_of(text_col).alias("_text"), length_of(docs, length_col))
        .join(F.broadcast(some), id_col)
        .repartition(n, id_col)
        .groupBy(id_col, *names)
        .agg(F.min(F.struct("_text", "_length")).alias("_one"))
    )

    def kernel(keys, ids, *columns):
        found = [extractor()(t, n) for t, n in zip(columns[-2], columns[-1], strict=True)]
        return {
            "key": keys,
            "id": [str(i) for i in ids],
            "marks": [list(m) for m in zip(*columns[:-2], strict=True)],
            "slots": [s for s, _ in found],
            "counts": [c for _, c in found],
        }

    made = texts.select(F.xxhash64(id_col).alias("key"), id_col, *names, "_one._text", "_one._length")
    rows = stored(map_rows(made, "key bigint, id string, marks array<int>, slots array<int>, counts array<float>", kernel), "sample")
    common = rows.select(F.explode("slots").alias("slot")).groupBy("slot").count().where(F.col("count") >= least).orderBy(F.desc("count"), "slot").limit(most)
    chosen = np.sort(np.array([r.slot for r in common.select("slot").collect()], dtype=np.int64))
    shared = spark.sparkContext.broadcast(chosen)

    def known(keys, ids, labelled, slots, counts):
        kept = [places(shared.value, np.array(s, dtype=np.int64))[1] for s in slots]
        return {
            "key": keys,
            "id": ids,
            "marks": labelled,
            "n": [int(k.sum()) for k in kept],
            "slots": [np.array(s, dtype=np.int32)[k].tobytes() for s, k in zip(slots, kept, strict=True)],
            "counts": [np.array(c, dtype=np.float32)[k].tobytes() for c, k in zip(counts, kept, strict=True)],
        }

    short = stored(map_rows(rows, "key bigint, id string, marks array<int>, n bigint, slots binary, counts binary", known), "short")
    upto = F.sum("n").over(Window.orderBy("key", "id"))  # at most ``bound`` rows
    fits = short.select("key", "id", "n").withColumn("upto", upto).where(F.col("upto") <= entries).select("key", "id")
    found = short.join(F.broadcast(fits), ["key", "id"]).collect()
    found.sort(key=lambda r: (r.key, r.id))
    return [
        (tuple(r.marks), np.frombuffer(r.slots, dtype=np.int32).astype(np.int64), np.frombuffer(r.counts, dtype=np.float32))
        for r in found
    ]


def places(chosen: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``slots`` lie in the ascending ``chosen``, and which of them do."""
    if not chosen.size:
        return np.zeros(0, dtype=np.int64), np.zeros(slots.size, dtype=bool)
    at = np.minimum(np.searchsorted(chosen, slots), chosen.size - 1)
    there = chosen[at] == slots
    return at[there], there


def common_slots(sample: list, least: int, most: int) -> np.ndarray:
    """Slots of at least ``least`` sampled documents, the ``most`` commonest, ascending."""
    if not sample:
        return np.zeros(0, dtype=np.int64)
    slots, n = np.unique(np.concatenate([s for _, s, _ in sample]), return_counts=True)
    slots, n = slots[n >= least], n[n >= least]
    return np.sort(slots[np.argsort(-n, kind="stable")[:most]])


def sigmoid(x: float | np.ndarray):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
