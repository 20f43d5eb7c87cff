"""Signed, idempotent batches against a count of the final documents."""

import re
from collections import Counter

import pytest

from hazardframe.llm import common, packing, token_counts
from hazardframe.llm.token_counts import TokenLedger, counted


def plain(rows):
    total = Counter()
    for source, lang, text in rows:
        text = text or ""
        total[source, lang, "words-1", "docs"] += 1
        total[source, lang, "words-1", "tokens"] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
        total[source, lang, "bytes-1", "docs"] += 1
        total[source, lang, "bytes-1", "tokens"] += len(text.encode())
    return {k: v for k, v in total.items() if v or total[(*k[:3], "docs")]}


def as_dict(df):
    out = {}
    for r in df.collect():
        out[r.source, r.lang, r.tokenizer, "docs"] = r.n_docs
        out[r.source, r.lang, r.tokenizer, "tokens"] = r.n_tokens
    return out


def test_ledger(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "source string, lang string, text string, tokenizer string, n_docs int")
    first = [("a", "en", "one two\x0bthree"), ("a", "en", "one two\x0bthree"), ("a", None, "é ü"), (None, "de", None), ("b", "en", ""), ("b", "en", "x " * 100_000)]
    ledger = TokenLedger(spark, common.fresh_path(spark, "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("1", counted(make(first), 1))
    assert as_dict(ledger.totals()) == plain(first)
    assert not ledger.commit("1", counted(make(first), 1))
    old, new = [first[0], first[3]], [("a", "en", "revised text"), (None, "de", "jetzt da")]
    assert ledger.commit("2", counted(make(old), -1), counted(make(new), 1))
    final = [first[1], first[2], first[4], first[5], *new]
    assert as_dict(ledger.totals()) == plain(final)
    # a delta whose marker is missing does not count, and the next attempt replaces it
    counted(make(first), 1).write.parquet(f"{ledger.path}/deltas/3-died")
    assert as_dict(ledger.totals()) == plain(final)
    assert ledger.commit("3", counted(make(final[:1]), -1))
    assert as_dict(TokenLedger(spark, ledger.path).totals()) == plain(final[1:])
    assert ledger.commit("4", counted(make([]), 1))
    assert ledger.commit("5", counted(make(final[1:]), -1))
    assert ledger.totals().count() == 0


def test_tokenizer_version(spark):
    pytest.importorskip("public_tokenizers")
    path = packing.default_vocabulary()
    rows = spark.createDataFrame([("a", "en", "the cat, the hat"), ("a", "en", None)], "source string, lang string, text string")
    got = counted(rows, 1, {"byte_bpe_50k": token_counts.encoded_version(path)}).collect()
    assert sorted(r.n_tokens for r in got) == [0, len(packing.encoder(path)(["the cat, the hat"])[0])]


def test_first_of_two_writers_wins(spark):
    from threading import Barrier, Lock, Thread

    make = lambda n: spark.createDataFrame([("a", "en", "x y")] * n, "source string, lang string, text string")
    path = common.fresh_path(spark, "ledger")
    for _ in range(3):
        meet, alone, said = Barrier(2), Lock(), {}

        class Slow(TokenLedger):
            def _claim(self, batch, attempt, meet=meet, alone=alone):
                meet.wait(60)  # both have written their deltas and seen no marker
                with alone:  # renames are atomic on a cluster's store, not on a local disk
                    return super()._claim(batch, attempt)

        batch = f"b{_}"
        before = as_dict(TokenLedger(spark, path).totals()).get(("a", "en", "words-1", "docs"), 0)
        writers = [Thread(target=lambda n=n: said.update({n: Slow(spark, path).commit(batch, counted(make(n), 1))})) for n in (1, 2)]
        for w in writers:
            w.start()
        for w in writers:
            w.join()
        assert sorted(said.values()) == [False, True]
        won = next(n for n, ok in said.items() if ok)
        assert as_dict(TokenLedger(spark, path).totals())["a", "en", "words-1", "docs"] == before + won
        assert not TokenLedger(spark, path).commit(batch, counted(make(5), 1))


def test_changes_in_one_scan(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "en", "one 2"), ("a", "en", None), ("b", None, "three")], "source string, lang string, text string")
    got = token_counts.changed(rows, [(F.lit(True), 1, F.col("text")), (F.col("text").rlike("[0-9]"), -1, F.lit("x y z"))])
    assert sorted((r.source, r.tokenizer, r.n_docs, r.n_tokens) for r in got.collect()) == [
        ("a", "bytes-1", -1, -5), ("a", "bytes-1", 1, 0), ("a", "bytes-1", 1, 5), ("a", "words-1", -1, -3), ("a", "words-1", 1, 0), ("a", "words-1", 1, 2), ("b", "bytes-1", 1, 5), ("b", "words-1", 1, 1),
    ]
