"""The queries of this subpackage, as registered for the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.llm.common import fresh_path, small_batches, spread, table
from hazardframe.llm.decontaminate import find_leaks
from hazardframe.llm.fingerprint import fingerprint_documents
from hazardframe.llm.packing import default_vocabulary, pack_documents
from hazardframe.llm.pii import pii_digest
from hazardframe.llm.quality import score_quality, train_quality
from hazardframe.llm.secrets import secret_digest
from hazardframe.llm.simhash import near_duplicates
from hazardframe.llm.suffix_dedup import repeat_digest
from hazardframe.llm.token_counts import NATIVE, WORDS, TokenLedger, changed, encoded_version
from hazardframe.llm.toxicity import score_toxicity, train_chain

#: Documents of fewer words are sent twice by the first batch of op6.
SHORT = 20


def op1_suffix_dedup(spark, sf_dir):
    return repeat_digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secret_digest(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)


def _token_totals(spark, sf_dir, versions):
    """Totals of the whole table, reached by way of other states; each batch is one scan.

    In first come all documents as drafted, without digits, and short ones a second
    time; then the second copies are deleted and the drafts revised to the true
    texts. The first batch is sent twice, as after a lost acknowledgement.
    """
    small_batches(spark)
    docs = spread(table(spark, sf_dir, "documents").select("source", "lang", "text"))
    text = F.coalesce("text", F.lit(""))
    short = F.regexp_count(text, F.lit(WORDS)) < SHORT
    draft, revised = F.translate(text, "0123456789", ""), text.rlike("[0-9]")
    ledger = TokenLedger(spark, fresh_path(spark, "ledger"))
    first = changed(docs, [(F.lit(True), 1, draft), (short, 1, text)], versions)
    ledger.commit("load", first)
    ledger.commit("revise", changed(docs, [(short, -1, text), (revised, -1, draft), (revised, 1, text)], versions))
    ledger.commit("load", first)
    return ledger.totals()


def op6_token_counts(spark, sf_dir):
    """Words, bytes and ids of ``byte_bpe_50k`` of every document, by source and language."""
    return _token_totals(spark, sf_dir, NATIVE | {"byte_bpe_50k": encoded_version(default_vocabulary())})


def native_token_counts(spark, sf_dir):
    """The same operator with the versions that SQL can count, too."""
    return _token_totals(spark, sf_dir, NATIVE)


NATIVE_SQL = r"""
with d as (select source, lang, coalesce(text, '') as text from documents),
 v as (select source, lang, 'words-1' as tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n from d
       union all select source, lang, 'bytes-1', strlen(text) from d)
select source, lang, tokenizer, cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_tokens
from v group by source, lang, tokenizer
"""


def op7_toxicity(spark, sf_dir):
    """The chain over the two marks of ``labels``: low quality first, then toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = train_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return score_toxicity(docs, chain)


def op8_pii(spark, sf_dir):
    return pii_digest(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_fingerprint": op3_fingerprint,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "native_token_counts": native_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {"native_token_counts": NATIVE_SQL}
