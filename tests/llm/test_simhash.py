"""Fingerprints from the definition, BK-trees against all pairs, components against a plain search."""

import random
import re

import pytest
import xxhash

from hazardframe.llm import simhash as sh
from hazardframe.llm.components import components


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprint():
    rnd = random.Random(0)
    for _ in range(200):
        text = "".join(rnd.choice(["The", "cat", "É", "İx", " ", "  ", "\n", "\x0b", "\x1c", " ", "Z"]) for _ in range(rnd.randint(0, 30)))
        assert sh.simhash(text) == plain(text), repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_all_pairs(seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    numbers = sorted({rnd.choice(centres) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) & sh.FULL for _ in range(200)})
    tree = sh.BKTree()
    for x in numbers:
        tree.add(x)
    for x in numbers[::7]:
        assert sorted(tree.near(x)) == [y for y in numbers if (x ^ y).bit_count() <= 4]
    want = least_reachable(numbers, lambda a, b: (a ^ b).bit_count() <= 4)
    got = dict(sh.local_components(numbers))
    assert {x: got.get(x, x) for x in numbers} == want


@pytest.mark.parametrize("limits", [sh.LIMITS, (1, 3, 2)])
def test_links_connect_what_is_near(spark, limits):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    numbers = sorted({(rnd.choice(centres) ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))})) & sh.FULL for _ in range(150)} | {0, sh.FULL})
    table = spark.createDataFrame([(sh._signed(x),) for x in numbers], "number long")
    links = sh.near_links(table, limits)
    assert all(((r.u ^ r.v) & sh.FULL) for r in links.collect())
    found = {r.node: r.root for r in components(links).collect()}
    got = {}
    for x in numbers:
        got.setdefault(found.get(sh._signed(x), sh._signed(x)), set()).add(x)
    want = {}
    for x, root in least_reachable(numbers, lambda a, b: (a ^ b).bit_count() <= 4).items():
        want.setdefault(root, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 2000 + i) for i in range(50)]
    loose = [(rnd.randrange(3000, 3100), rnd.randrange(3000, 3100)) for _ in range(60)]
    links = chain + hub + loose + [(5, 5), (6, 5)]
    nodes = sorted({x for p in links if p[0] != p[1] for x in p})
    pairs = {frozenset(p) for p in links}
    want = least_reachable(nodes, lambda a, b: frozenset((a, b)) in pairs)
    rnd.shuffle(links)
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long"), small).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long"), small).count() == 0


def corpus():
    rnd = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"w{rnd.randrange(500)}" for _ in range(300)]
        for _ in range(5):
            new = list(words)
            for _ in range(rnd.randint(0, 2)):
                new[rnd.randrange(300)] = "edit"
            rows.append((len(rows) + 10, " ".join(new)))
    return rows + [(3, None), (4, ""), (None, ""), (2, "solo"), (2, "solo"), (None, "alone text here"), (None, "alone text here"), (900, "long word " * 60_000)]


def test_rows(spark, docs_of):
    rows = corpus()
    keys = list(range(len(rows)))
    prints = [plain(t) for _, t in rows]
    root = least_reachable(keys, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    name = {}
    for k in keys:
        name.setdefault(root[k], []).append(rows[k][0])
    want = sorted(((rows[k][0], f"{prints[k]:016x}", min((i for i in name[root[k]] if i is not None), default=None)) for k in keys), key=str)
    assert sorted((tuple(r) for r in sh.near_duplicates(docs_of(rows)).collect()), key=str) == want
    kept = sh.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w[2] for w in want}, key=str)
    assert sh.near_duplicates(docs_of([])).count() == 0 == sh.keep_one(docs_of([])).count()
