"""Near copies against the Jaccard similarity of all pairs."""

import random

import pytest

from hazardframe.llm import near_copies as nc


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(25):
        words = [f"w{rnd.randrange(2000)}" for _ in range(rnd.choice([60, 200, 400]))]
        for _ in range(6):
            new = list(words)
            for _ in range(rnd.randint(0, len(words) // 40)):
                new[rnd.randrange(len(new))] = f"edit{rnd.randrange(99)}"
            rows.append((len(rows) + 10, " ".join(new)))
    boiler = " ".join(f"b{i}" for i in range(40))
    rows += [(500 + i, boiler + " " + " ".join(f"own{i}x{k}" for k in range(rnd.randint(5, 40)))) for i in range(30)]
    return rows + [(3, None), (4, ""), (None, " "), (2, "solo"), (2, "solo"), (1, "Solo"), (None, "alone text here"), (None, "alone text here"), (900, "long word " * 60_000)]


def groups_of(rows):
    sets = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and near(sets[a], sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


@pytest.mark.parametrize(("held", "shards"), [(nc.HELD, nc.BANDS), (500, nc.BANDS), (500, 1)])
def test_rows(spark, docs_of, held, shards):
    rows = corpus(1)
    best = {}
    for (d, t), g in zip(rows, groups_of(rows), strict=True):
        if g not in best or ((d is None), d or 0) < ((best[g][0] is None), best[g][0] or 0):
            best[g] = (d, t)
    assert 30 < len(best) < 100
    docs = docs_of(rows)
    kept = nc.keep_distinct(docs, held=held, shards=shards)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in best.values()), key=str)
    assert nc.keep_distinct(docs_of([])).count() == 0


def test_trees_of_components():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(120):
        new = list(words) if i % 3 else [f"x{i}y{k}" for k in range(100)]
        new[i : i + rnd.randint(0, 4)] = [f"e{i}"]
        texts.append(" ".join(new))
    sets = {i: nc.shingle_set(t) for i, t in enumerate(texts)}
    group = dict(zip(range(120), groups_of([(i, t) for i, t in enumerate(texts)]), strict=True))
    links = nc.verified(list(sets.items()))
    assert all(near(plain(texts[u]), plain(texts[v])) for u, v in links)
    assert len(links) == 120 - len(set(group.values()))


def test_pipeline_drops_copies_of_many_differing_bits(spark, docs_of):
    import corpus_pipeline
    from hazardframe.llm.simhash import simhash

    rnd = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        for at in (30, 80, 130, 170):
            copy[at] = "edit"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    pairs = [(rows[i][1], rows[i + 1][1]) for i in range(0, 120, 2)]
    assert all(near(plain(a), plain(b)) for a, b in pairs)
    assert sum((simhash(a) ^ simhash(b)).bit_count() > 4 for a, b in pairs) > 30
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()) == list(range(0, 120, 2))
