"""Prefix hashes against plain string comparison; the query against a plain loop."""

import hashlib
import random

import numpy as np
import pytest

from hazardframe.llm import fingerprint as fp


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(5))
def test_spans_and_extensions(seed):
    rnd = random.Random(seed)
    a = "".join(rnd.choice("abé\U0001f600") for _ in range(200))
    b = a[20:120] + "".join(rnd.choice("abé") for _ in range(90))
    x, y = fp.PrefixHash(a), fp.PrefixHash(b)
    i, j = np.array([rnd.randrange(200) for _ in range(300)]), np.array([rnd.randrange(190) for _ in range(300)])
    assert x.common_extension(y, i, j).tolist() == [common(a[p:], b[q:]) for p, q in zip(i, j, strict=True)]
    n = np.array([rnd.randint(0, min(200 - p, 190 - q, 3)) for p, q in zip(i, j, strict=True)])
    assert x.equal(y, i, j, n).tolist() == [a[p : p + k] == b[q : q + k] for p, q, k in zip(i, j, n, strict=True)]
    for k in (1, 3, 16):
        hs, ht = x.spans(k), y.spans(k)
        first = {}
        for h, s in [*zip(hs.tolist(), (a[p : p + k] for p in range(201 - k))), *zip(ht.tolist(), (b[p : p + k] for p in range(191 - k)))]:
            assert first.setdefault(h, s) == s
        assert len(set(first.values())) == len(first)


def test_likeness_follows_the_overlap():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    own = fp.sketch(fp.PrefixHash(text))
    assert fp.likeness(own, fp.sketch(fp.PrefixHash(text))) == 1.0
    near = []
    for share in (0.02, 0.1, 0.3, 0.6, 1.0):
        cut = int(len(text) * (1 - share))
        other = text[:cut] + "".join(rnd.choice("klmnopq") for _ in range(len(text) - cut))
        spans = lambda t: {t[i : i + fp.SPAN] for i in range(len(t) - fp.SPAN + 1)}
        truth = len(spans(text) & spans(other)) / len(spans(text) | spans(other))
        near.append(fp.likeness(own, fp.sketch(fp.PrefixHash(other))))
        assert abs(near[-1] - truth) < 0.13
    assert near == sorted(near, reverse=True)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        new = fp.edited(t, nxt)
        a, b, c = (fp.sketch(fp.PrefixHash(x)) for x in (t, new, nxt))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.text_form(a), fp.text_form(b), fp.likeness(a, b), fp.likeness(a, c), common(t, new)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_rows(spark, docs_of, parts):
    rnd = random.Random(parts)
    rows = [(rnd.randrange(80), " ".join(rnd.choice(["aé", "bb", "c"]) for _ in range(rnd.randint(0, 60)))) for _ in range(70)]
    rows += [(100, None), (None, "x y z" * 9), (None, None), (40, ""), (41, "long " * 50_000), (40, "")]
    assert sorted((tuple(r) for r in fp.fingerprint_documents(docs_of(rows), parts=parts).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, "abc def")], [(None, "b"), (None, "a"), (None, "c")]])
def test_few_rows(spark, docs_of, rows):
    assert sorted((tuple(r) for r in fp.fingerprint_documents(docs_of(rows)).collect()), key=str) == brute(rows)
