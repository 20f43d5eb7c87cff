"""The registered totals against a count of every document of the table."""

import re
from collections import Counter

import pytest

from hazardframe.llm import packing, queries

pytest.importorskip("public_tokenizers")


def test_totals_are_those_of_the_table(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [("a", "en", "short, with 12 digits"), ("a", "en", "short, with 12 digits"), ("a", None, "é ü"), (None, "de", None), ("b", "en", "")]
    rows += [("b", "en", f"{i} and 345 " + "the cat, the hat " * i) for i in range(30)] + [("a", "en", "no digit here " * 200)]
    spark.createDataFrame(rows, "source string, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    slow, want = Tokenizer.from_file(packing.default_vocabulary()), {}
    for source, lang, text in rows:
        text = text or ""
        sizes = {"words-1": len(re.findall(r"[^\x20\x09-\x0D]+", text)), "bytes-1": len(text.encode()), "byte_bpe_50k": len(slow.encode(text, add_special_tokens=False).ids)}
        for version, n in sizes.items():
            want.setdefault((source, lang, version), Counter()).update(docs=1, tokens=n)
    found = queries.op6_token_counts(spark, str(tmp_path)).collect()
    assert len(found) == len(want)
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in found} == {k: (v["docs"], v["tokens"]) for k, v in want.items()}
    native = queries.native_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in native} == {k: (v["docs"], v["tokens"]) for k, v in want.items() if k[2] != "byte_bpe_50k"}
