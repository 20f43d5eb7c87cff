"""Document fingerprints from prefix polynomial hashes.

A text's code points are summed into prefix arrays modulo two primes; the hash of
any span then costs one subtraction and one product, so spans are compared and
longest common extensions found (by binary search) without reading characters.

The fingerprint is a min-wise sketch of the hashes of all spans of a fixed length:
the span hashes are dealt by their lower bits into slots, and each slot keeps a
part of its least hash. Texts agree in a slot with the probability of the overlap
of their span sets, so the share of agreeing slots estimates it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import SLICE, arrow_schema, gathered, text_of, type_of

#: The two moduli (primes) and bases.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points of a span, slots of a fingerprint, bits kept of a slot.
SPAN, SLOTS, BITS = 16, 128, 16


class Powers:
    """Powers of the bases, grown as needed."""

    def __init__(self):
        self.of = [np.ones(1, dtype=np.uint64) for _ in MODULI]

    def upto(self, n: int) -> list[np.ndarray]:
        while self.of[0].size < n:
            for k, (p, b) in enumerate(zip(MODULI, BASES, strict=True)):
                have = self.of[k]
                step = np.uint64(pow(b, have.size, p))
                self.of[k] = np.concatenate([have, have * step % np.uint64(p)])
        return [x[:n] for x in self.of]


POWERS = Powers()


class PrefixHash:
    """Prefix arrays of a text; equal spans have equal hashes wherever they lie."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = points.size
        self.power = POWERS.upto(self.n + 1)
        self.prefix = []
        for p, power in zip(MODULI, self.power, strict=True):
            # a span's sum carries its place as a power, which a product undoes or changes
            terms = points % np.uint64(p) * power[: self.n] % np.uint64(p)
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.prefix.append(sums % np.uint64(p))

    def _moved(self, start: np.ndarray, length: np.ndarray, top: int) -> list[np.ndarray]:
        """Hashes of spans, each moved to the place ``top`` (no smaller than any start)."""
        out = []
        power = POWERS.upto(top + 1)
        for k, p in enumerate(MODULI):
            p = np.uint64(p)
            span = (self.prefix[k][start + length] + p - self.prefix[k][start]) % p
            out.append(span * power[k][top - start] % p)
        return out

    def spans(self, length: int) -> np.ndarray:
        """One 62-bit hash per start of a span, the same for equal spans of any text.

        The places are undone with inverse powers, so texts of any length agree.
        """
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        parts = []
        for k, p in enumerate(MODULI):
            u = np.uint64(p)
            span = (self.prefix[k][length:] + u - self.prefix[k][:m]) % u
            parts.append(span * INVERSE.upto(m)[k] % u)
        return (parts[0] << np.uint64(31)) | parts[1]

    def equal(self, other: PrefixHash, i, j, length) -> np.ndarray:
        """Whether spans of ``length`` at ``i`` here and at ``j`` there are equal (all may be arrays)."""
        i, j, length = (np.asarray(x, dtype=np.int64) for x in (i, j, length))
        top = int(max(i.max(initial=0), j.max(initial=0)))
        ours, theirs = self._moved(i, length, top), other._moved(j, length, top)
        return (ours[0] == theirs[0]) & (ours[1] == theirs[1])

    def common_extension(self, other: PrefixHash, i, j) -> np.ndarray:
        """The length of the longest common extension of positions ``i`` here and ``j`` there."""
        i, j = np.broadcast_arrays(np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64))
        low, high = np.zeros(i.shape, dtype=np.int64), np.minimum(self.n - i, other.n - j)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(other, i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


class Inverses(Powers):
    """Powers of the bases' inverses."""

    def upto(self, n: int) -> list[np.ndarray]:
        while self.of[0].size < n:
            for k, (p, b) in enumerate(zip(MODULI, BASES, strict=True)):
                have = self.of[k]
                step = np.uint64(pow(pow(b, -1, p), have.size, p))
                self.of[k] = np.concatenate([have, have * step % np.uint64(p)])
        return [x[:n] for x in self.of]


INVERSE = Inverses()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sketch(hashed: PrefixHash, span: int = SPAN, slots: int = SLOTS) -> np.ndarray:
    """The fingerprint as ``slots`` numbers; an empty text's are all zero.

    A text shorter than a span counts as one span; a slot without hashes borrows
    from the next filled one, in a ring, with the distance mixed in.
    """
    if hashed.n == 0:
        return np.zeros(slots, dtype=np.uint16)
    h = _mixed(hashed.spans(min(span, hashed.n)))
    slot, rest = h % np.uint64(slots), h >> np.uint64(16)
    none = np.uint64(2**64 - 1)
    least = np.full(slots, none)
    np.minimum.at(least, slot.astype(np.int64), rest)
    filled = np.flatnonzero(least != none)
    at = np.arange(slots)
    source = filled[np.searchsorted(filled, at) % filled.size]
    far = ((source - at) % slots).astype(np.uint64)
    return (_mixed(least[source] + far * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def text_form(numbers: np.ndarray) -> str:
    return numbers.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of agreeing slots, corrected for agreement by chance; 0 to 1."""
    chance = 2.0**-BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _parts(docs: DataFrame, id_col: str, parts: int) -> list:
    """Ids of the table at which parts begin, descending, the largest first; a bounded number."""
    cuts = [i / parts for i in range(parts + 1)]
    row = docs.agg(F.percentile_approx(id_col, cuts, 10 * parts).alias("cuts"), F.max(id_col).alias("top")).first()
    return sorted({*(row.cuts or []), row.top} - {None}, reverse=True)


def _less(ascending: list, value: Column) -> Column:
    """How many of ``ascending`` lie below ``value``, found in two steps of about its root's length."""
    step = math.isqrt(len(ascending)) + 1
    chunks = [ascending[i : i + step] for i in range(0, len(ascending), step)]
    listed = lambda xs: F.array(*map(F.lit, xs))
    full = F.size(F.filter(listed([c[0] for c in chunks]), lambda b: b < value))
    inside = F.size(F.filter(F.element_at(F.array(*map(listed, chunks)), F.greatest(full, F.lit(1))), lambda b: b < value))
    return F.when(full == 0, F.lit(0)).otherwise((full - 1) * step + inside)


def with_following(docs: DataFrame, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, list]:
    """``docs`` dealt into runs of descending ids, each run ending with a copy of the row that follows it.

    One shuffle of the texts. The runs begin at ids of the table, whose number is
    bounded by ``parts``; the rows with those ids are sent to the run before, too,
    and those with the largest id to the last run, where the order closes. Equal
    ids are ordered by text; rows with a null id come after all others.
    """
    starts = _parts(docs, id_col, parts)
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    if not starts:  # only null ids: one run in order of the texts
        rows = rows.select(F.lit(0).alias("_run"), F.lit(False).alias("_guest"), id_col, "_text")
        return rows.unionAll(rows.orderBy("_text").limit(1).withColumn("_guest", F.lit(True)).select(rows.columns)), starts
    last = len(starts) - 1
    run = F.when(F.col(id_col).isNull(), F.lit(last)).otherwise(last - _less(sorted(starts), F.col(id_col))).cast("int")
    first = F.coalesce(F.col(id_col).isin(starts), F.lit(False))
    before = F.when(F.col("_own") == 0, F.lit(last)).otherwise(F.col("_own") - 1)
    places = F.when(F.col("_first"), F.array(F.struct(F.col("_own").alias("r"), F.lit(False).alias("g")), F.struct(before.alias("r"), F.lit(True).alias("g"))))
    rows = rows.withColumns({"_own": run, "_first": first})
    rows = rows.withColumn("_at", F.explode(places.otherwise(F.array(F.struct(F.col("_own").alias("r"), F.lit(False).alias("g"))))))
    return rows.select(F.col("_at.r").alias("_run"), F.col("_at.g").alias("_guest"), id_col, "_text"), starts


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next`` and ``common_prefix``
    (the longest common extension of the text and its edited text at their
    starts). The next document is the one of the next smaller id; after the last
    comes the first. Null texts are empty and have the zero fingerprint, whose
    likeness to another empty text is 1; equal ids are ordered by text, null ids
    come last; of a single document the next one is itself.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, starts = with_following(docs, id_col, text_col, parts)
    rows = rows.repartition(max(1, min(parts // 4, len(starts))), "_run").sortWithinPartitions("_run", "_guest", F.desc_nulls_last(id_col), "_text")
    schema = f"`{id_col}` {type_of(docs, id_col)}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"
    target = arrow_schema(spark, schema)

    def row(doc, text, hashed, own, following, theirs):
        new = edited(text, following)
        new_hashed = PrefixHash(new)
        other = sketch(new_hashed)
        return (
            doc, len(text), hashlib.sha256(new.encode()).hexdigest(), text_form(own), text_form(other),
            likeness(own, other), likeness(own, theirs), int(hashed.common_extension(new_hashed, 0, 0)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in a run: own rows, then the guests, of which the first follows the last own row
        out, held, current = [], None, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for r, guest, doc, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    if r != current:
                        held, current = None, r
                    if guest and held is None:
                        continue  # a further guest
                    hashed = PrefixHash(text)
                    own = sketch(hashed)
                    if held is not None:
                        out.append(row(*held, text, own))
                    held = None if guest else (doc, text, hashed, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)
                    out = []

    return gathered(rows).mapInArrow(run, schema)
