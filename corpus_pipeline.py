"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Its result is written as Parquet and read
again as the next stage's documents. Null texts count as empty; null ids, repeated
rows, very long texts, empty tables and further columns are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardframe.llm.common import forget, fresh_path, scratch, table
from hazardframe.llm.decontaminate import without_leaks
from hazardframe.llm.near_copies import keep_distinct
from hazardframe.llm.packing import pack_documents
from hazardframe.llm.quality import keep_good, train_quality
from hazardframe.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a null text is judged as the empty one."""
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash and BK-trees over five-word shingles, similarity 0.8.

    The one of the least id stays; null and empty texts are one group.
    """
    return keep_distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"), whole=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; null texts stay null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, placed in sequences; a null text is the closing id alone."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]

#: No stage but the last two could be written in SQL, so the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all of ``documents``.

    A stage's input, and what its operator stored on the way, is removed when its
    result is written; the last stage's input when the application ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
