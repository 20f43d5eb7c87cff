"""Packing: an exact round trip, full windows, and ids equal to the tokenizer's own."""

import os
import random
import zlib

import numpy as np
import pytest

from hazardframe.llm import packing

pytest.importorskip("public_tokenizers")


def direct(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(packing.default_vocabulary()).encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_file():
    rnd = random.Random(2)
    end = "<|endoftext|>"
    texts = [end, f"{end} hi", f"hi {end}", f"a{end}b{end}{end} c", "<|endoftext", f"x\n\n{end}  y", ""]
    some = ["é", "日本", "\u0301", "\u200b", "\xa0", "\x00", "\x85", "🙂", "'ll", "'LL", "12", "½", "  ", "\t\n", "<|", "|>", "_", "ǅ", "\u2028", "\U000e0001"]
    texts += ["".join(rnd.choice(some) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    assert [x + [1] for x in packing.encoder(packing.default_vocabulary())(texts)] == direct(texts)


@pytest.mark.parametrize("seed", range(20))
def test_packer_covers_each_id_once(seed):
    rnd = random.Random(seed)
    packer, lengths, rows = packing.Packer(), {}, []
    for doc in range(rnd.randint(0, 300)):
        lengths[doc] = rnd.choice([1, rnd.randint(1, 300), rnd.randint(1, 3000), rnd.randint(1, 20000), 2048, 256])
        packer.add(doc, lengths[doc])
        if rnd.random() < 0.1:
            rows += packer.pack()
            assert packer.held < 2048
    rows += packer.finish()
    by_doc, by_seq = {}, {}
    for doc, start, length, seq, offset, tier, _ in rows:
        assert length > 0
        by_doc.setdefault(doc, []).append((start, length))
        by_seq.setdefault((seq, tier), []).append((offset, length))
    for doc, n in lengths.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == n
    loose = 0
    for (_, tier), items in by_seq.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        loose += at != tier
        assert at <= tier
    assert loose <= 1


def test_rows(spark, docs_of):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["thé", "x1", "the", "\n\n", "  a", "### b", "don't"]) for _ in range(rnd.randint(0, 3000)))) for i in range(60)]
    rows += [(None, None), (7, ""), (7, ""), (8, "word " * 60_000), (70, "<|endoftext|> a <|endoftext|>")]
    out = packing.pack_documents(docs_of(rows), with_ids=True).collect()
    want = sorted(tuple(x) for x in direct([t or "" for _, t in rows]))
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids) > 0
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for items in seqs.values():
        total = sum(n for _, n in items)
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding <= 2 * 2048
    once = [r for r in out if r.doc_id not in (7, 8, None)]
    whole = {}
    for r in sorted(once, key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).extend(r.ids)
        assert r.doc_tokens >= len(whole[r.doc_id])
    assert all(tuple(x) in set(want) for x in whole.values())
    assert sum(r.length for r in out) == sum(map(len, want))
    assert packing.pack_documents(docs_of([])).count() == 0


def test_step_groups_are_balanced(spark, docs_of):
    rnd = random.Random(1)
    out = packing.pack_documents(docs_of([(i, "the cat " * rnd.randint(1, 900)) for i in range(400)], 1)).collect()
    tokens = {}
    for r in out:
        tokens[r.step_group] = tokens.get(r.step_group, 0) + r.length
    full = sorted(tokens.values())[1:]
    assert all(t == packing.STEP_TOKENS for t in full) and len(full) >= 2
