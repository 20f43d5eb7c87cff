"""Removed bytes against a table of all windows of the corpus."""

import hashlib
import random
from collections import Counter

import pytest

from hazardframe.llm import common
from hazardframe.llm import suffix_dedup as sd


def brute(rows, depth):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for (doc, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((doc, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    say = lambda k: "".join(rnd.choice("abcdé ") for _ in range(k))
    shared = [say(rnd.randint(30, 150)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(shared)[rnd.randint(0, 20) :] if rnd.random() < 0.4 else say(rnd.randint(0, 120)) for _ in range(rnd.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[5][1]) for i in range(3)]
    rows += [(200 + i, say(30) + shared[0] + say(30)) for i in range(10)]
    for i in range(10):  # near copies
        t = rows[i][1]
        k = rnd.randrange(len(t) + 1)
        rows.append((300 + i, t[:k] + "#" + t[k:]))
    rows += [(400, "ab" * 200), (401, "c" * 100), (403, "c" * 700 + "d"), (404, "e" + "c" * 300), (402, "line of text\n" * 30), (None, None), (None, shared[1]), (7, rows[7][1]), (8, None), (500, "")]
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("depth", [20, 50])
def test_rows(spark, docs_of, seed, depth, monkeypatch):
    if seed:  # every key of some rows is a frequent one
        monkeypatch.setattr(common, "FREQUENT", seed)
    rows = corpus(seed)
    out = sd.repeat_digest(docs_of(rows, 3), depth=depth, shard=[sd.SHARD, 300, 1][seed], hot=[sd.HOT, 1, 300][seed])
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, depth)


def test_full_depth(spark, docs_of):
    rnd = random.Random(1)
    say = lambda k: " ".join(f"w{rnd.randrange(3000)}" for _ in range(k))
    passage = say(60)
    rows = [(i, say(100)) for i in range(20)] + [(30 + i, f"{say(20)} {passage} {say(20)}") for i in range(6)] + [(90, say(30_000)), (91, passage[:199])]
    rows += [(92, rows[3][1][:400] + "X" + rows[3][1][400:]), (93, rows[4][1]), (94, rows[4][1])]
    out = sd.repeat_digest(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 200)


def test_empty(spark, docs_of):
    assert sd.repeat_digest(docs_of([])).count() == 0
    assert [r.n_removed for r in sd.repeat_digest(docs_of([(1, None), (2, "short")])).collect()] == [0, 0]


def test_equal_windows_share_a_label():
    rnd = random.Random(2)
    for depth in (8, 40):
        text = "".join(rnd.choice("ab") for _ in range(600)).encode()
        label = {}
        first, windows, labels, _ = sd.stretches(text, depth)
        assert windows.sum() == len(text) - depth + 1
        for f, n, x in zip(first.tolist(), windows.tolist(), labels.tolist(), strict=True):
            for i in range(f, f + n):
                assert label.setdefault(text[i : i + depth], x) == x
