"""Hierarchical packing of documents into context windows of several sizes.

Each document's ids (with the closing id) are routed to the smallest tier that
holds them; what is longer than the largest window is cut into full windows
first. Tiers are packed from the largest down: every window starts with an item
of its own tier and its gap is filled from the shorter tiers, whole items first,
then one that is cut. A window leaves the packer only when it is exactly full, so
only the tail of a partition can need padding; the tail is closed with the
largest tiers that it fills. Windows are dealt to step groups of equal token
budget, largest first.

Packing is local to a partition of the input: no document text is shuffled, a
task holds less than one window of unplaced ids besides the slice it works on,
and the padding is below one window a partition.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hazardframe.llm.common import SLICE, arrow_schema, text_of, type_of

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group; a multiple of every tier.
STEP_TOKENS = 32 * 2048
CLOSING_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str):
    """A function from a list of texts to a list of id lists, as ``tokenizers`` gives them without added special tokens.

    A special token's string inside a text has that token's id, as the file says.
    Where the folder of the file also holds the same vocabulary as ranks, texts
    that hold no such string are encoded by the ranks, which is faster and gives
    the same ids (tested); all others go to ``tokenizers`` itself.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    by_file = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return by_file
    import public_tokenizers
    import tiktoken

    added = re.compile("|".join(re.escape(t.content) for t in own.get_added_tokens_decoder().values()) or r"(?!)")
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [by_file([x])[0] if added.search(x) else made.encode_ordinary(x) for x in texts]

    return encode


class Packer:
    """Places items (document, start, length) into windows; see the module."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers = sorted(tiers)
        self.step_tokens = step_tokens
        self.waiting: dict[int, deque] = {t: deque() for t in self.tiers}
        self.held = 0
        self.sequences = 0
        self.groups = 0
        self.open_groups: dict[int, int] = {}

    def add(self, doc: object, length: int) -> None:
        """Queue a document's ids; those beyond the largest window are cut off as full ones."""
        top = self.tiers[-1]
        start = 0
        while length - start >= top:
            self.waiting[top].append((doc, start, top))
            self.held += top
            start += top
        if start < length:
            self._queue((doc, start, length - start))
            self.held += length - start

    def _queue(self, item: tuple) -> None:
        tier = next(t for t in self.tiers if item[2] <= t)
        self.waiting[tier].append(item)

    def _step(self, size: int) -> int:
        for group, room in self.open_groups.items():
            if room >= size:
                if room == size:
                    del self.open_groups[group]
                else:
                    self.open_groups[group] = room - size
                return group
        group, self.groups = self.groups, self.groups + 1
        if size < self.step_tokens:
            self.open_groups[group] = self.step_tokens - size
        return group

    def _close(self, items: list[tuple], tier: int) -> list[tuple]:
        """Rows (document, start, length, sequence, offset, tier, step group)."""
        rows, offset = [], 0
        step = self._step(tier)
        for doc, start, length in items:
            rows.append((doc, start, length, self.sequences, offset, tier, step))
            offset += length
        self.held -= offset
        self.sequences += 1
        return rows

    def _fill(self, tier: int) -> list[tuple]:
        """Items that fill one window of ``tier`` exactly; called only if enough is held."""
        items: list[tuple] = []
        gap = tier
        own = [t for t in reversed(self.tiers) if t <= tier]
        while gap:
            # the longest waiting item that fits whole, from the tiers below the gap
            fits = next((t for t in own if self.waiting[t] and self.waiting[t][0][2] <= gap), None)
            if fits is not None:
                item = self.waiting[fits].popleft()
                items.append(item)
                gap -= item[2]
                continue
            # none fits: cut the shortest kind that waits, in any tier
            cut = next(t for t in self.tiers if self.waiting[t])
            doc, start, length = self.waiting[cut].popleft()
            items.append((doc, start, gap))
            self._queue((doc, start + gap, length - gap))
            gap = 0
        return items

    def pack(self) -> list[tuple]:
        """Close every window that its own and shorter tiers fill; the rest keeps waiting."""
        rows: list[tuple] = []
        for tier in reversed(self.tiers):
            while self.waiting[tier] and sum_upto(self.waiting, tier) >= tier:
                rows += self._close(self._fill(tier), tier)
        while self.held >= self.tiers[-1]:  # short items only: let them share the largest windows
            rows += self._close(self._fill(self.tiers[-1]), self.tiers[-1])
        return rows

    def finish(self) -> list[tuple]:
        """Close the tail with the largest tiers that it fills, then one window with the rest."""
        rows = self.pack()
        while self.held:
            tier = next((t for t in reversed(self.tiers) if t <= self.held), None)
            if tier is None:
                items = [x for t in reversed(self.tiers) for x in self.waiting[t]]
                for t in self.tiers:
                    self.waiting[t].clear()
                rows += self._close(items, self.tiers[-1])
            else:
                rows += self._close(self._fill(tier), tier)
        return rows


def sum_upto(waiting: dict[int, deque], tier: int) -> int:
    """Ids that wait in the tiers up to ``tier``, counted no further than needed."""
    total = 0
    for t, items in waiting.items():
        if t <= tier:
            for item in items:
                total += item[2]
                if total >= tier:
                    return total
    return total


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it lies in which window.

    ``sequence_id`` and ``step_group`` carry the number of the input partition in
    their upper bits, so that tasks need not agree; a task that is run again
    makes the same rows. ``with_ids`` adds the token ids of the piece.

    A null or empty text is the closing id alone. Null ids, ties and repeated
    rows are packed like any other row; an empty table gives an empty one. A very
    long text is encoded whole and cut into full windows; a text with a special
    token's string has that token's id there. Further columns are never read.
    """
    path = vocabulary or default_vocabulary()
    schema = (
        f"`{id_col}` {type_of(docs, id_col)}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
        " sequence_id bigint, offset bigint, tier int, step_group bigint" + (", ids array<int>" if with_ids else "")
    )
    target = arrow_schema(docs.sparkSession, schema)

    def table(rows: list[tuple], base: int) -> pa.RecordBatch:
        pieces = [ids[start : start + length] for (_, ids), start, length, *_ in rows]
        made = {
            id_col: [doc for (doc, _), *_ in rows],
            "start": [r[1] for r in rows],
            "length": [r[2] for r in rows],
            "ids_crc32": [zlib.crc32(x) for x in pieces],
            "doc_tokens": [len(ids) for (_, ids), *_ in rows],
            "sequence_id": [base + r[3] for r in rows],
            "offset": [r[4] for r in rows],
            "tier": [r[5] for r in rows],
            "step_group": [base + r[6] for r in rows],
        }
        if with_ids:
            made["ids"] = pieces
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(tiers, step_tokens)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids.append(CLOSING_ID)
                    packer.add((doc, np.array(ids, dtype="<u4")), len(ids))
                if rows := packer.pack():
                    yield table(rows, base)
        if rows := packer.finish():
            yield table(rows, base)

    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, schema)
