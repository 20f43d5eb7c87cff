"""Copies by the share of the item's words that they keep, wherever the edits lie."""

import random

import numpy as np
import pytest

from hazardframe.llm import decontaminate as dc


def best_score(item, doc):
    """The most of 5 a kept word less 4 an inserted one, over all alignments of all of ``item``; words outside are free."""
    n, m = len(item), len(doc)
    low = -(10**6)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            kept = h[i - 1][j - 1] + (5 if item[i - 1] == doc[j - 1] else 0) if j else low
            h[i][j] = max(kept, h[i - 1][j], h[i][j - 1] - 4 if j else low)
    return max(h[n])


@pytest.mark.parametrize("seed", range(20))
def test_whole_alignment(seed):
    rnd = random.Random(seed)
    item = [rnd.randrange(5) for _ in range(rnd.randint(1, 12))]
    doc = [rnd.randrange(5) for _ in range(rnd.randint(0, 20))]
    similar, matches, a, z = dc.align_whole(np.array(item, dtype=np.int64), np.array(doc, dtype=np.int64))
    inserted = round(matches / similar - len(item)) if matches else 0
    assert 5 * matches - 4 * inserted == best_score(item, doc)
    assert 0 <= a <= z <= len(doc) and (similar >= dc.SIMILAR) == (best_score(item, doc) >= 4 * len(item))


def test_many_alignments_at_once():
    rnd = np.random.default_rng(4)
    items, part = rnd.integers(0, 6, (50, 9)), rnd.integers(0, 6, 17)
    assert list(zip(*dc.align_many(items, part), strict=True)) == [dc.align_whole(x, part) for x in items]


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 25])
def test_copies_of_items_of_any_length(n):
    """Every item that keeps 0.8 of its words among others is found, however often its 3-grams occur."""
    rnd = random.Random(n)
    say = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    items = [say(n) for _ in range(60)]
    held = dc.Items(list(range(60)), [" ".join(x) for x in items])
    search = dc.Search(held, held.seeds(np.array([rnd.randrange(5) for _ in range(held.keys.size)])), True)
    for i, item in enumerate(items):
        kind = rnd.randrange(2)
        if kind:
            text = replaced(item, rnd.sample(range(n), n // 5))
        else:
            text = list(item)
            for at in sorted(rnd.sample(range(1, n), min(n - 1, n // 4)), reverse=True):
                text.insert(at, "inserted")
        assert i in {x[0] for x in search(held.numbers(" ".join(say(20) + text + say(20))))}, (item, text)


def test_items_of_one_template():
    import time

    rnd = random.Random(1)
    body = [f"t{i}" for i in range(18)]
    texts = [" ".join([*body[:9], f"a{i}", *body[9:], f"b{i}"]) for i in range(20_000)]
    held = dc.Items(list(range(20_000)), texts)
    search = dc.Search(held, held.seeds(np.full(held.keys.size, 7)), True)
    say = lambda k: [f"x{rnd.randrange(3000)}" for _ in range(k)]
    half = say(60) + body[:9] + say(100) + body[9:] + say(40)
    began = time.time()
    assert search(held.numbers(" ".join(half))) == []
    print("none held:", time.time() - began)
    began = time.time()
    full = say(60) + texts[77].split() + say(40)
    found = {x[0]: x[1] for x in search(held.numbers(" ".join(full)))}
    assert len(found) == 20_000 and found[77] == 1 and found[78] == 18 / 20
    print("all held:", time.time() - began)
    began = time.time()
    parted = say(60) + [*body[:5], "new", *body[5:9], "a77", *body[9:], "b77"] + say(40)
    found = {x[0]: x[1] for x in search(held.numbers(" ".join(parted)))}
    assert found[77] == 20 / 21 and len(found) == 20_000
    print("all aligned:", time.time() - began)


def replaced(words, places):
    return [f"edit{at}" if at in places else w for at, w in enumerate(words)]


def cases():
    """(item words, kept words, text) of copies with edits anywhere, the ends among them."""
    rnd = random.Random(6)
    say = lambda n: [f"w{rnd.randrange(100_000)}" for _ in range(n)]
    out = []
    for k in range(120):
        n = rnd.randint(16, 60)
        edits = int(n * 0.2) if k % 2 else int(n * 0.2) + rnd.randint(1, 3)
        places = rnd.sample(range(n), edits)
        if k % 3 == 0:
            places = list({1, n - 2, *places[2:]})
        item = say(n)
        out.append((item, n - len(places), " ".join(say(30) + replaced(item, places) + say(30))))
    item = say(15)
    return [*out, (item, 13, " ".join(say(9) + replaced(item, (1, 13)) + say(9)))]


def test_rows(spark, docs_of):
    made = cases()
    docs = docs_of([(d, t) for d, (_, _, t) in enumerate(made)])
    benchmark = spark.createDataFrame([(i, " ".join(item)) for i, (item, _, _) in enumerate(made)], "item_id long, text string")
    want = {(i, i) for i, (item, kept, _) in enumerate(made) if kept >= 0.8 * len(item) - 1e-9}
    assert 60 <= len(want) < len(made)
    found = dc.find_leaks(docs, benchmark, whole=True).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    for r in found:
        item, kept, _ = made[r.doc_id]
        assert r.matches == kept and r.similarity == pytest.approx(kept / len(item))
    assert {r.doc_id for r in dc.without_leaks(docs, benchmark, whole=True).collect()} == set(range(len(made))) - {d for d, _ in want}
    local = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, benchmark).collect()}
    assert local < want


def test_query_takes_whole_items(spark, docs_of, tmp_path):
    from hazardframe.llm import queries

    made = [c for c in cases() if c[1] >= 0.8 * len(c[0]) - 1e-9]
    docs_of([(d, t) for d, (_, _, t) in enumerate(made)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(item)) for i, (item, _, _) in enumerate(made)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in queries.op5_decontaminate(spark, str(tmp_path)).collect()) == list(range(len(made)))
