"""Induced suffix sorting of a shard with queues on disk.

The suffixes of a text are sorted by induction: the leftmost S-type (LMS) suffixes
are ordered first, L-type suffixes are induced from them in ascending order, and
S-type suffixes from those in descending order. Both passes draw suffixes from a
priority queue keyed by first symbol and order of insertion. As the passes only
insert at or past the symbol they are at, each symbol's part of the queue is a
list that is written once and read once; parts beyond a memory bound, which a shard
of usual size exceeds several times, lie in an unlinked file of Spark's scratch
folder. A queue entry is a tuple (position, length of the prefix
in common with the entry before it); the common prefix of an induced suffix is one
more than the least common prefix passed since the last insertion under its symbol.

The same two passes first order the LMS substrings; their names form a shorter
string, whose suffixes are ordered by doubling the ranks of names (a recursion of
the symbol-wise passes does not pay, as nearly every name is a symbol of its own).
Common prefixes count up to ``depth``, which is all that the caller asks for, and
suffixes that agree that far may come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries that a pass handles at once, and bytes of queues that are kept in memory.
BATCH = 1 << 16
MEMORY = 1 << 20

BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    while _POWERS[0].size < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            have = _POWERS[k]
            _POWERS[k] = np.concatenate([have, have * np.uint64(pow(base, have.size, 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


class SpanHash:
    """Hashes of spans of a text, equal for equal spans wherever they lie."""

    def __init__(self, symbols: np.ndarray):
        self.size = symbols.size
        self.sums = np.zeros(symbols.size + 1, dtype=np.uint64)
        power, self.inverse = powers(symbols.size + 1)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all spans of ``length``, by start."""
        return (self.sums[length:] - self.sums[:-length]) * self.inverse[: self.size - length + 1]

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Lengths of the common prefixes of suffixes ``a`` and ``b``, up to ``depth``."""
        out = np.minimum(depth, self.size - np.maximum(a, b))
        at = np.flatnonzero(self(a, out) != self(b, out))  # most others agree to the end or differ soon
        low, high = np.zeros(at.size, dtype=np.int64), out[at] - 1
        a, b = a[at], b[at]
        guess = np.minimum(8, high)
        while at.size:
            same = self(a, guess) == self(b, guess)
            low, high = np.where(same, guess, low), np.where(same, high, guess - 1)
            open_ = low < high
            out[at[~open_]] = low[~open_]
            at, a, b, low, high = at[open_], a[open_], b[open_], low[open_], high[open_]
            guess = (low + high + 1) >> 1
        return out


class Store:
    """The memory that all parts of a queue share, and the file for what goes beyond it."""

    def __init__(self, memory: int = MEMORY):
        self.left, self.file, self.size = memory, None, 0

    def write(self, column: np.ndarray) -> tuple:
        if self.file is None:
            scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.file = tempfile.TemporaryFile(dir=scratch if os.path.isdir(scratch) else None)
        at, self.size = self.size, self.size + column.nbytes
        self.file.seek(at)
        self.file.write(column.tobytes())
        return at, column.dtype, column.size

    def read(self, at: int, dtype: np.dtype, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * dtype.itemsize), dtype=dtype)


class Part:
    """The entries under one symbol: chunks that are read in order, or from the end."""

    def __init__(self, store: Store):
        self.store, self.chunks = store, []

    def put(self, *columns: np.ndarray) -> None:
        size = sum(c.nbytes for c in columns)
        if size <= self.store.left:
            self.store.left -= size
            self.chunks.append((size, columns))
        else:
            self.chunks.append((0, [self.store.write(c) for c in columns]))

    def _get(self, chunk: tuple) -> tuple[np.ndarray, ...]:
        size, columns = chunk
        if size or (columns and isinstance(columns[0], np.ndarray)):
            return columns
        return tuple(self.store.read(*where) for where in columns)

    def _joined(self, chunks: list[tuple]) -> tuple[np.ndarray, ...]:
        """Small chunks as one, so that a pass works on long arrays."""
        columns = [self._get(c) for c in chunks]
        for size, _ in chunks:
            self.store.left += size
        return columns[0] if len(columns) == 1 else tuple(np.concatenate(c) for c in zip(*columns, strict=True))

    @staticmethod
    def _entries(chunk: tuple) -> int:
        first = chunk[1][0]
        return first.size if isinstance(first, np.ndarray) else first[2]

    def take(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Entries in order, those added meanwhile too; each is dropped once read."""
        while self.chunks:
            count, n = 0, 0
            while count < len(self.chunks) and n < BATCH:
                n += self._entries(self.chunks[count])
                count += 1
            now, self.chunks = self.chunks[:count], self.chunks[count:]
            yield self._joined(now)

    def take_back(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The same from the end; entries inside what is yielded keep their order."""
        while self.chunks:
            count, n = 0, 0
            while count < len(self.chunks) and n < BATCH:
                count += 1
                n += self._entries(self.chunks[-count])
            now, self.chunks = self.chunks[-count:], self.chunks[:-count]
            yield self._joined(now)


class RangeMinimum:
    """Least values of ranges of a short array of small numbers."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= values.size:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))
        self.log = np.zeros(values.size + 2, dtype=np.int8)
        for k in range(1, len(self.levels) + 1):
            self.log[1 << k :] = k

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over ``low`` to ``high``, both included."""
        out = np.empty(low.size, dtype=self.levels[0].dtype)
        level = self.log[high - low + 1]
        for k, values in enumerate(self.levels):
            at = np.flatnonzero(level == k)
            if at.size:
                out[at] = np.minimum(values[low[at]], values[high[at] + 1 - (1 << k)])
        return out


class Sorter:
    """Induced sorting of ``symbols`` (small non-negative numbers, ending with the only zero)."""

    def __init__(self, symbols: np.ndarray, depth: int, memory: int = MEMORY):
        self.text, self.depth, self.memory = symbols, depth, memory
        self.alphabet = int(symbols.max()) + 1 if symbols.size else 1
        self.place = np.int32 if symbols.size < 1 << 31 else np.int64
        n = symbols.size
        # a run of equal symbols has the type of its last one, which the next symbol tells
        ends = np.flatnonzero(np.append(symbols[1:] != symbols[:-1], True)) if n else np.zeros(0, np.int64)
        rising = np.append(symbols[ends[:-1]] < symbols[ends[:-1] + 1], True) if n else np.zeros(0, bool)
        self.is_s = np.repeat(rising, np.diff(ends, prepend=-1))
        lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        self.lms = lms.astype(self.place)

    def _insert(self, parts: list[Part], at: np.ndarray, lcp: np.ndarray | None, carry: np.ndarray, begun: np.ndarray, small: bool) -> None:
        """Queue the predecessors of one type of the suffixes ``at``, under their symbols."""
        some = np.flatnonzero(at > 0)
        some = some[self.is_s[at[some] - 1] == small]
        if lcp is not None and not some.size:
            np.minimum(carry, lcp.min(), out=carry)
            return
        if not some.size:
            return
        symbol = self.text[at[some] - 1]
        order = np.argsort(symbol, kind="stable")
        some, symbol = some[order], symbol[order]
        cuts = np.append(0, np.flatnonzero(symbol[1:] != symbol[:-1]) + 1)
        ends = np.append(cuts[1:], symbol.size)
        before = (at[some] - 1).astype(self.place)
        if lcp is None:
            for a, z in zip(cuts.tolist(), ends.tolist(), strict=True):
                parts[symbol[a]].put(before[a:z])
            return
        ranges = RangeMinimum(lcp)
        low = np.empty_like(some)
        low[1:] = some[:-1] + 1
        low[cuts] = 0
        least = ranges(low, some)
        heads = symbol[cuts]
        least[cuts] = np.minimum(least[cuts], carry[heads])
        common = np.minimum(least.astype(np.int16) + 1, self.depth).astype(lcp.dtype)
        common[cuts[~begun[heads]]] = 0
        begun[heads] = True
        np.minimum(carry, lcp.min(), out=carry)
        last = some[ends - 1]
        rest = np.full(heads.size, np.iinfo(lcp.dtype).max, dtype=lcp.dtype)
        inner = last + 1 < at.size
        rest[inner] = ranges(last[inner] + 1, np.full(int(inner.sum()), at.size - 1))
        carry[heads] = rest
        for a, z in zip(cuts.tolist(), ends.tolist(), strict=True):
            parts[symbol[a]].put(before[a:z], common[a:z])

    def _batches(self, columns: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        for a in range(0, columns[0].size, BATCH):
            yield tuple(c[a : a + BATCH] for c in columns)

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray | None, hashed: SpanHash | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """Induce all suffixes from the LMS suffixes ``seeds`` in ascending order.

        Yields (symbol, positions, common prefixes with the larger one before) of
        the S-type suffixes in descending order and of the L-type ones in
        ascending order (there with the smaller one before), symbol by symbol,
        from the largest; a negative symbol -1 - c marks the L-type ones. Common
        prefixes are carried if ``seed_lcp`` is given.
        """
        with_lcp = seed_lcp is not None
        store = Store(self.memory)
        larger = [Part(store) for _ in range(self.alphabet)]
        kept = [Part(store) for _ in range(self.alphabet)]
        carry, begun = np.zeros(self.alphabet, dtype=np.uint8), np.zeros(self.alphabet, dtype=bool)
        starts = np.searchsorted(self.text[seeds], np.arange(self.alphabet + 1)) if with_lcp or seeds.size else np.zeros(self.alphabet + 1, int)
        top = np.full(self.alphabet, -1, dtype=np.int64)  # the largest L-type suffix of each symbol
        for c in range(self.alphabet):
            if with_lcp:
                carry[:] = 0  # suffixes of different symbols have nothing in common
            for chunk in larger[c].take():
                for batch in self._batches(chunk):
                    kept[c].put(*batch)
                    top[c] = batch[0][-1]
                    self._insert(larger, batch[0].astype(np.int64), batch[1] if with_lcp else None, carry, begun, False)
            own = seeds[starts[c] : starts[c + 1]].astype(np.int64)
            if own.size:
                lcp = None
                if with_lcp:
                    lcp = seed_lcp[starts[c] : starts[c + 1]].copy()
                    lcp[0] = 0 if top[c] < 0 else hashed.common(np.array([top[c]]), own[:1], self.depth)[0]
                for batch in self._batches((own,) if lcp is None else (own, lcp)):
                    self._insert(larger, batch[0], batch[1] if with_lcp else None, carry, begun, False)
        smaller = [Part(store) for _ in range(self.alphabet)]
        carry[:], begun[:] = 0, False
        for c in reversed(range(self.alphabet)):
            if with_lcp:
                carry[:] = 0
            low = -1
            for chunk in smaller[c].take():
                for batch in self._batches(chunk):
                    low = int(batch[0][-1])
                    self._insert(smaller, batch[0].astype(np.int64), batch[1] if with_lcp else None, carry, begun, True)
                    yield c, batch[0], batch[1] if with_lcp else None
            above = 0
            if with_lcp and low >= 0 and top[c] >= 0:
                above = int(hashed.common(np.array([top[c]]), np.array([low]), self.depth)[0])
            for chunk in kept[c].take_back():
                at, lcp = chunk[0][::-1].astype(np.int64), None
                if with_lcp:  # from the smaller neighbour to the larger one
                    lcp = np.concatenate([[above], chunk[1][:0:-1]]).astype(np.uint8)
                    above = int(chunk[1][0])
                for batch in self._batches((at,) if lcp is None else (at, lcp)):
                    self._insert(smaller, batch[0], batch[1] if with_lcp else None, carry, begun, True)
                    yield -1 - c, batch[0], batch[1] if with_lcp else None

    def ordered_lms(self, hashed: SpanHash) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in ascending order (to ``depth``), and their common prefixes."""
        lms, n = self.lms.astype(np.int64), self.lms.size
        if not n:
            return lms, np.zeros(0, dtype=np.uint8)
        # any order within a symbol sorts the substrings up to the next LMS position
        unsorted = lms[np.argsort(self.text[lms], kind="stable")]
        number = np.full(self.text.size, -1, dtype=self.place)
        number[lms] = np.arange(n)
        found = [x[x >= 0] for c, at, _ in self.induce(unsorted.astype(self.place), None) if c >= 0 for x in (number[at],)]
        order = np.concatenate([*found, np.array([n - 1], dtype=self.place)] if self.text[lms[-1]] == 0 else found)[::-1].astype(np.int64)
        length = np.append(np.diff(lms) + 1, 1)
        spans = hashed(lms, np.minimum(length, self.text.size - lms))
        a, b = order[:-1], order[1:]
        # a rank is the place of the first of its equals, so that ties can be refined alone
        new = np.append(True, (length[a] != length[b]) | (spans[a] != spans[b]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = order[~(new & np.append(new[1:], True))]
        reach = 1
        while tied.size and reach <= self.depth:  # a name covers a symbol at least
            following = np.where(tied + reach < n, rank[np.minimum(tied + reach, n - 1)] + 1, 0)
            r = rank[tied]
            by = np.argsort(r * (n + 1) + following)
            tied, r, following = tied[by], r[by], following[by]
            first = np.append(True, r[1:] != r[:-1])
            new = first | np.append(True, following[1:] != following[:-1])
            index = np.arange(tied.size)
            rank[tied] = r + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(first, index, 0))
            tied = tied[~(new & np.append(new[1:], True))]
            reach *= 2
        order = np.argsort(rank, kind="stable")
        lms = lms[order]
        lcp = np.zeros(n, dtype=np.uint8)
        lcp[1:] = hashed.common(lms[:-1], lms[1:], self.depth)
        return lms, lcp


def repeated_positions(texts: list[bytes], depth: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each text, which of its ``len - depth + 1`` spans of ``depth`` bytes start anywhere else, too.

    Anywhere is any other place of any of the texts; a span never crosses texts.
    A run of one byte of more than ``2 depth`` is sorted as one of that length, which
    has the same spans inside and across its ends, all those inside more than once.
    """
    if depth > 254:
        raise ValueError("common prefixes are kept in a byte")
    kept = [short_runs(np.frombuffer(t, dtype=np.uint8), 2 * depth) for t in texts]
    found = _repeated([t if k is None else np.frombuffer(t, dtype=np.uint8)[k].tobytes() for t, k in zip(texts, kept, strict=True)], depth, memory)
    return [m if k is None else _stretched(m, k, len(t) - depth + 1) for t, k, m in zip(texts, kept, found, strict=True)]


def short_runs(raw: np.ndarray, most: int) -> np.ndarray | None:
    """Positions that are left where of runs of one byte only the last ``most`` stay; None if all are."""
    if raw.size <= most:
        return None
    begin = np.flatnonzero(np.append(True, raw[1:] != raw[:-1]))
    size = np.diff(begin, append=raw.size)
    if size.max() <= most:
        return None
    long = np.flatnonzero(size > most)
    edges = np.zeros(raw.size + 1, dtype=np.int8)
    edges[begin[long]] = 1
    edges[begin[long] + size[long] - most] = -1
    return np.flatnonzero(np.cumsum(edges[:-1], dtype=np.int8) == 0)


def _stretched(marked: np.ndarray, kept: np.ndarray, n: int) -> np.ndarray:
    """Marks of the ``n`` spans of the whole text from those of the spans at its ``kept`` positions.

    Those that begin at other positions lie inside a run, as all of the first ones kept of it do.
    """
    out = np.ones(n, dtype=bool)
    out[kept[: marked.size]] = marked
    return out


def _repeated(texts: list[bytes], depth: int, memory: int) -> list[np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()) + 1, dtype=np.uint16)
    symbols[:-1] = 1  # between texts; the end is the only zero
    raw = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
    symbols[: raw.size] = raw
    symbols[: raw.size] += 2
    symbols[starts + sizes] = 1
    sorter = Sorter(symbols, depth, memory)
    hashed = SpanHash(symbols)
    seeds, lcp = sorter.ordered_lms(hashed)
    marked = np.zeros(symbols.size, dtype=bool)
    last = -1
    for _, at, common in sorter.induce(seeds.astype(sorter.place), lcp, hashed):
        hit = common >= depth
        marked[at[hit]] = True
        marked[at[:-1][hit[1:]]] = True
        if hit.size and hit[0] and last >= 0:
            marked[last] = True
        last = int(at[-1])
    return [marked[a : a + max(0, n - depth + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
