"""Every registered query on a small folder of tables, against plain versions that share no code with the operators."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate_whole import best_score
from test_fingerprint import common
from test_scans import plain_pii, plain_secrets
from test_simhash import least_reachable
from test_simhash import plain as plain_simhash
from test_suffix_dedup import brute as brute_repeats

from hazardframe.llm import queries

pytest.importorskip("public_tokenizers")

GOOD = "the river runs past an old mill and the town wakes early on market days while rain falls".split()
JUNK = ["buy!!!", "$$$", "###", "CLICK", "***", "now!!!"]
RUDE = ["idiot", "scum", "moron"]


def tables():
    rnd = random.Random(12)
    say = lambda n: " ".join(rnd.choice([*GOOD, f"w{rnd.randrange(4000)}"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([3, 5, 8, 12, 15, 20, 30, 40])] + [(20, None), (21, "too short"), (None, say(18))]
    passage = say(70)
    docs, labels = [], []
    for i in range(320):
        text = say(rnd.randint(5, 60))
        if i % 4 == 0:
            text = " ".join(rnd.choice(JUNK) if rnd.random() < 0.5 else w for w in text.split())
        if i % 5 == 0:
            text += " " + rnd.choice(RUDE)
        if i % 16 == 1:
            text += rnd.choice([" password: hunter22x", " AKIA" + "Q7" * 9, " " + "0f3a" * 8, " joe@mail.example.org", " 10.0.255.7", " 4111 1111 1111 1111", " +49 30 1234567"])
        if i % 20 == 2:
            held = rnd.choice(items[:8])[1].split()
            for at in rnd.sample(range(len(held)), len(held) // 5):
                held[at] = "edited"
            text += " " + " ".join(held) + " " + say(5)
        if i % 40 == 3:
            text += " " + passage
        docs.append((i, text))
        labels.append((i, int(i % 4 != 0), int(i % 5 == 0)))
    docs += [(1000 + i, docs[i][1]) for i in range(12)] + [(1100 + i, docs[i][1] + " tail") for i in range(8)]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "z" * 900), (2004, say(9000)), (2005, "<|endoftext|> é 🙂 <|endoftext|>")]
    return docs, labels + [(5000, 1, 1), (None, 1, 0), (9, None, 1)], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, items = tables()
    at = tmp_path_factory.mktemp("tables")
    # two columns more, whose names the operators use themselves
    rows = [(i, t, ["en", "de", None][n % 3], ["a", "b"][n % 2], None if t is None else len(t), "x", 1) for n, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, number int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, labels, items, rows


@pytest.fixture()
def run(spark, folder):
    return lambda name: queries.QUERIES[name](spark, folder[0]).collect()


def test_op1(run, folder):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run("op1_suffix_dedup")]
    assert sorted(got, key=str) == brute_repeats(folder[1], 200)
    assert sum(x[2] > 0 for x in got) > 15


def test_op2(run, folder):
    prints = {i: plain_simhash(t) for i, t in folder[1]}
    want = least_reachable(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run("op2_simhash")} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def span_hash(points, moduli=(2147483647, 2147483629), bases=(911382323, 972663749)):
    """The polynomial hash of a span by its definition: the sum of (code point + 1) times powers of a base."""
    a, b = (sum((c + 1) * pow(base, k, p) for k, c in enumerate(points)) % p for p, base in zip(moduli, bases, strict=True))
    return a << 31 | b


def mixed(h):
    h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
    return h ^ h >> 32


def plain_sketch(text):
    if not text:
        return [0] * 128
    points, least = [ord(c) for c in text], {}
    width = min(16, len(points))
    for at in range(len(points) - width + 1):
        h = mixed(span_hash(points[at : at + width]))
        least[h % 128] = min(least.get(h % 128, 2**64), h >> 16)
    out = []
    for slot in range(128):
        far = next(d for d in range(128) if (slot + d) % 128 in least)
        out.append(mixed((least[(slot + far) % 128] + far * 0x9E3779B97F4A7C15) % 2**64) % 2**16)
    return out


def test_op3(run, folder):
    docs = sorted(((i, t or "") for i, t in folder[1]), reverse=True)
    got = {r.doc_id: r for r in run("op3_fingerprint")}
    assert len(got) == len(docs)
    form = lambda s: struct.pack(">128H", *s).hex()
    like = lambda a, b: max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 2**-16) / (1 - 2**-16))
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.common_prefix) == (len(t), hashlib.sha256(new.encode()).hexdigest(), common(t, new))
        if len(t) < 3000 and k % 4 == 0:
            own, other, theirs = plain_sketch(t), plain_sketch(new), plain_sketch(after[:3000])
            assert (r.fingerprint, r.edited_fingerprint) == (form(own), form(other))
            assert r.near_edited == pytest.approx(like(own, other))
            if len(after) < 3000:
                assert r.near_next == pytest.approx(like(own, theirs))


@pytest.mark.parametrize(("name", "plain", "counts"), [("op4_secrets", plain_secrets, ("assign", "access", "hex")), ("op8_pii", plain_pii, ("email", "ip", "card", "phone"))])
def test_op4_and_op8(run, folder, name, plain, counts):
    got = {r.doc_id: r for r in run(name)}
    assert len(got) == len(folder[1])
    for i, t in folder[1]:
        spans = plain(t or "")
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        assert [got[i][f"n_{k}"] for k in counts] == [sum(s[0] == k for s in spans) for k in counts]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {x for x in joined.split(",") if x} <= set(got[i].spans.split(","))
    assert sum(bool(r.spans) for r in got.values()) >= 5


def test_op5(run, folder):
    _, docs, _, items, _ = folder
    split = lambda t: [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split()]
    want = set()
    for i, t in docs:
        words = split(t or "")
        for item, x in items:
            held = split(x or "")
            if len(held) >= 3 and best_score(held, words) >= 4 * len(held):
                want.add((i, item))
    assert {(r.doc_id, r.item_id) for r in run("op5_decontaminate")} == want
    assert len(want) >= 16


def test_op6(run, folder):
    from tokenizers import Tokenizer

    from hazardframe.llm.packing import default_vocabulary

    encode, want = Tokenizer.from_file(default_vocabulary()), Counter()
    for _, t, lang, source, *_ in folder[4]:
        t = t or ""
        sizes = {"words-1": len(t.encode().split()), "bytes-1": len(t.encode()), "byte_bpe_50k": len(encode.encode(t, add_special_tokens=False).ids)}
        for version, n in sizes.items():
            want[source, lang, version, "docs"] += 1
            want[source, lang, version, "tokens"] += n
    for name, versions in (("op6_token_counts", 3), ("native_token_counts", 2)):
        got = Counter()
        for r in run(name):
            got[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
            got[r.source, r.lang, r.tokenizer, "tokens"] += r.n_tokens
        assert got == {k: v for k, v in want.items() if versions == 3 or k[2] != "byte_bpe_50k"}


@pytest.mark.parametrize(("name", "column", "truth"), [("op7_toxicity", "p_toxic", 2), ("op10_quality", "score", 1)])
def test_op7_and_op10(run, folder, name, column, truth):
    """Accuracy on the rows that were held out."""
    got = {r.doc_id: r for r in run(name)}
    assert len(got) == len(folder[1])
    labels = {x[0]: x[truth] for x in folder[2] if x[0] in got and x[truth] is not None and x[0] != 9}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r[column] <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95 and len(held) > 50


def test_op9(run, folder):
    from tokenizers import Tokenizer

    from hazardframe.llm.packing import default_vocabulary

    own = Tokenizer.from_file(default_vocabulary())
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in folder[1]}
    seen, sequences = {i: 0 for i in ids}, {}
    for r in sorted(run("op9_packing"), key=lambda r: r.start):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[i] == len(x) for i, x in ids.items())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
