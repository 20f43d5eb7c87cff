"""Induced sorting against plain sorting, with queues in memory and on disk."""

import random
from collections import Counter

import numpy as np
import pytest

from hazardframe.llm import suffix_array as sa


def plain(texts, depth):
    seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    return [[seen[t[i : i + depth]] > 1 for i in range(max(0, len(t) - depth + 1))] for t in texts]


def some_texts(rnd, alphabet, n, size):
    pool = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(1, size))) for _ in range(4)]
    out = []
    for _ in range(n):
        t = b"".join(rnd.choice(pool)[rnd.randint(0, 5) :] for _ in range(rnd.randint(0, 3)))
        if t and rnd.random() < 0.5:
            k = rnd.randrange(len(t))
            t = t[:k] + bytes([rnd.choice(alphabet)]) + t[k + 1 :]
        out.append(t)
    return out


@pytest.mark.parametrize("memory", [sa.MEMORY, 0, 300])
@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh ", bytes(range(256))])
@pytest.mark.parametrize("seed", range(8))
def test_repeats(seed, alphabet, memory, monkeypatch):
    rnd = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(sa, "BATCH", 7)
    for depth in (1, 2, 5, 12):
        texts = some_texts(rnd, alphabet, rnd.randint(0, 12), 40)
        got = sa.repeated_positions(texts, depth, memory)
        assert [g.tolist() for g in got] == plain(texts, depth), (texts, depth)


@pytest.mark.parametrize("seed", range(10))
def test_order_and_common_prefixes(seed):
    rnd = np.random.default_rng(seed)
    text = np.append(rnd.integers(1, 4 + seed, 300), 0).astype(np.uint16)
    sorter, hashed = sa.Sorter(text, 200), sa.SpanHash(text)
    seeds, lcp = sorter.ordered_lms(hashed)
    by_symbol = {}
    for c, at, _ in sorter.induce(seeds.astype(sorter.place), lcp, hashed):
        by_symbol.setdefault(c if c >= 0 else -1 - c, []).extend(at.tolist())
    order = [i for c in sorted(by_symbol) for i in by_symbol[c][::-1]]
    raw = text.tolist()
    want = sorted(range(300), key=lambda i: raw[i:])
    assert order == want
    assert seeds.tolist() == [i for i in sorted(range(301), key=lambda i: raw[i:]) if i in set(sorter.lms.tolist())]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_one_byte(seed):
    rnd = random.Random(seed)
    for depth in (1, 3, 7):
        texts = [b"".join(rnd.choice([b"a", b"b", b" "]) * rnd.choice([1, 2, depth, 2 * depth, 2 * depth + 1, 60]) for _ in range(rnd.randint(0, 6))) for _ in range(5)]
        assert [g.tolist() for g in sa.repeated_positions(texts, depth)] == plain(texts, depth), (texts, depth)


def test_a_long_run_costs_little():
    import time

    began = time.time()
    got = sa.repeated_positions([b"x" + b"a" * 5_000_000 + b"y"], 200)[0]
    assert time.time() - began < 10
    assert not got[0] and got[1:4_999_802].all() and not got[4_999_802:].any()


def test_a_usual_shard_exceeds_the_memory_of_its_queues(monkeypatch):
    written = []
    write = sa.Store.write
    monkeypatch.setattr(sa.Store, "write", lambda self, column: written.append(column.nbytes) or write(self, column))
    words = np.random.default_rng(1).integers(97, 123, (20_000, 6)).astype(np.uint8)
    words[:, 5] = 32
    noise = words[np.random.default_rng(2).integers(0, 20_000, 175_000)].tobytes()
    assert len(noise) > sa.MEMORY
    sa.repeated_positions([noise], 200)
    assert sum(written) > sa.MEMORY


def test_periodic_and_large():
    assert sa.repeated_positions([b"a" * 1000], 200)[0].all()
    rnd = np.random.default_rng(0)
    noise = rnd.integers(97, 123, 200_000).astype(np.uint8).tobytes()
    got = sa.repeated_positions([noise[:100_000], b"x" + noise[50_000:50_400] + b"y", noise[100_000:]], 200)
    assert np.flatnonzero(got[0]).tolist() == list(range(50_000, 50_201))
    assert np.flatnonzero(got[1]).tolist() == list(range(1, 202)) and not got[2].any()
