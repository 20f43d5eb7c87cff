"""Leaks against a plain alignment of every item with every whole document."""

import random

import numpy as np
import pytest

from hazardframe.llm import decontaminate as dc


def plain(item, doc):
    """Best local alignment by the textbook table; similarity as the operator defines it."""
    n, m = len(item), len(doc)
    h = [[0.0] * (m + 1) for _ in range(n + 1)]
    top = (0.0, 0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if item[i - 1] == doc[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            if h[i][j] > top[0]:
                top = (h[i][j], i, j)
    _, i, j = top
    matches = inserted = 0
    while h[i][j] > 0:
        if h[i][j] == h[i - 1][j - 1] + (1 if item[i - 1] == doc[j - 1] else -1):
            matches += item[i - 1] == doc[j - 1]
            i, j = i - 1, j - 1
        elif h[i][j] == h[i - 1][j] - 1:
            i -= 1
        else:
            inserted += 1
            j -= 1
    return matches / (n + inserted) if n else 0.0


@pytest.mark.parametrize("seed", range(10))
def test_alignment(seed):
    rnd = random.Random(seed)
    item = [rnd.randrange(6) for _ in range(rnd.randint(0, 12))]
    doc = [rnd.randrange(6) for _ in range(rnd.randint(0, 20))]
    got = dc.align(np.array(item, dtype=np.int64), np.array(doc, dtype=np.int64))
    assert got[0] == plain(item, doc)


def edit(rnd, words, share):
    out = []
    for w in words:
        x = rnd.random()
        if x < share / 2:
            out.append("edited")
        elif x < share * 0.75:
            out += [w, "inserted"]
        elif x >= share:
            out.append(w)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "a"] * 10
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rnd.randint(16, 40)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "the of"), (3, items[3][1]), (None, " ".join(say(20)))]
    docs = []
    for d in range(60):
        words = say(rnd.randint(0, 120))
        if d % 2:
            hold = dc.words_of(rnd.choice(items[:12])[1])
            at = rnd.randint(0, len(words))
            words = words[:at] + edit(rnd, hold, rnd.choice([0, 0.1, 0.2, 0.4])) + words[at:]
        docs.append((d, " ".join(words).replace(" the ", " The, ")))
    common = items[0][1]
    docs += [(100 + i, f"{' '.join(say(5))} {common}") for i in range(20)]
    docs += [(None, common), (7, None), (7, ""), (100, docs[60][1]), (200, " ".join([common] * 40))]
    return docs, items


@pytest.mark.parametrize("bound", [dc.BLOCK, 600])
def test_rows(spark, docs_of, bound):
    docs, items = corpus(bound)
    benchmark = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, places string, doc_id int")
    found = dc.find_leaks(docs_of(docs), benchmark, bound=bound).collect()
    want = []
    for d, t in docs:
        words = dc.words_of(t or "")
        for i, x in items:
            item = dc.words_of(x or "")
            if len(item) >= 3 and plain(item, words[:200]) >= 0.8:
                want.append((d, i))
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted(want, key=str)
    for r in found:
        text = next(t for d, t in docs if d == r.doc_id and t)
        assert 0 <= r.word_start < r.word_end <= len(dc.words_of(text)) and r.similarity >= 0.8
    kept = dc.without_leaks(docs_of(docs), benchmark, bound=bound)
    assert kept.columns == docs_of(docs).columns
    bad = {d for d, _ in want}
    clean = [(d, t) for d, t in docs if d not in bad or not t]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_parts_of_a_long_item_are_judged_together(spark, docs_of):
    rnd = random.Random(0)
    words = [f"w{rnd.randrange(4000)}" for _ in range(3000)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    edited = [w if i % 6 else "edit" for i, w in enumerate(words)]
    third, most = words[:1000], words[:2500]
    docs = docs_of([(1, " ".join(["x", *words])), (2, "y z"), (3, " ".join(edited)), (4, " ".join(third)), (5, " ".join([*most, *["own"] * 500]))])
    for whole in (False, True):
        found = dc.find_leaks(docs, benchmark, whole=whole).collect()
        assert sorted(r.doc_id for r in found) == [1, 3, 5]
        one = next(r for r in found if r.doc_id == 1)
        assert (one.matches, one.similarity, one.word_start, one.word_end) == (3000, 1.0, 1, 3001)
        assert next(r for r in found if r.doc_id == 3).matches >= 2490


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dc.find_leaks(docs_of([(1, "a b c d e")]), none).count() == 0
    assert dc.find_leaks(docs_of([]), some).count() == 0
    assert dc.without_leaks(docs_of([(1, "a b c d e"), (2, None)]), none).count() == 2
