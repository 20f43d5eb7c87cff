"""Delta-maintained token totals by source, language and tokenizer version.

A batch of changes is a set of signed documents: an insert counts +1, a delete
-1, and a revision is the delete of the old text and the insert of the new one; one
scan of a batch's table gives all its entries. A batch is summed into one small
table of signed totals before it is written, so that a total is the sum of the
deltas of all committed batches, whatever their order.

Each attempt writes its delta to a folder of its own. A batch becomes part of the
totals when its marker, which names that folder, is put in place by a rename that
does not replace; of several writers of one batch the first to do so wins and the
others remove what they wrote (on a store whose rename is atomic, as HDFS's is). A
delta that no marker names, of a job that died, never counts.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm.common import SLICE, text_of

#: Tokenizer versions that need no Python: name to the number of tokens of a text.
WORDS = r"[^\x20\x09-\x0D]+"
NATIVE = {
    "words-1": lambda text: F.regexp_count(text, F.lit(WORDS)).cast("long"),
    "bytes-1": lambda text: F.octet_length(text).cast("long"),
}
KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def counted(docs: DataFrame, sign: int, versions: dict | None = None, text_col: str = "text", text: Column | None = None) -> DataFrame:
    """Signed counts per document and tokenizer version.

    A null text counts as empty (a document of no tokens); a null source or
    language is a group of its own; every row counts, repeated ones too, and a very
    long text whole; an empty table gives none. Further columns are never read.
    """
    return changed(docs, [(F.lit(True), sign, text_of(text_col) if text is None else text)], versions)


def changed(docs: DataFrame, entries: list[tuple[Column, int, Column]], versions: dict | None = None) -> DataFrame:
    """Signed counts of several entries a row, in one scan: (whether the row has it, sign, text)."""
    versions = versions or NATIVE
    told = [F.when(holds, F.struct(F.lit(sign).cast("long").alias("sign"), F.coalesce(text, F.lit("")).alias("text"))) for holds, sign, text in entries]
    read = docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.explode(F.filter(F.array(*told), lambda e: e.isNotNull())).alias("e"),
    ).select("source", "lang", "e.sign", F.col("e.text").alias("_text"))
    # one pass over the texts: the counts of all versions, then one row per version
    each = [F.struct(F.lit(name).alias("tokenizer"), count(F.col("_text")).alias("n")) for name, count in versions.items()]
    return read.select("source", "lang", "sign", F.explode(F.array(*each)).alias("v")).select(
        "source", "lang", "v.tokenizer", F.col("sign").alias("n_docs"), (F.col("v.n") * F.col("sign")).alias("n_tokens")
    )


def encoded_version(path: str):
    """A version that counts the ids of a tokenizer file, in Arrow batches."""
    from hazardframe.llm.packing import encoder

    def count(texts: pd.Series) -> pd.Series:
        encode, held = encoder(path), texts.tolist()
        return pd.Series([len(x) for at in range(0, len(held), SLICE) for x in encode(held[at : at + SLICE])], dtype="int64")

    return F.pandas_udf(count, "bigint")


class TokenLedger:
    """Totals kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm = jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), conf)

    def _marker(self, batch: str):
        return self._path(f"{self.path}/commits/{batch}")

    def committed(self) -> dict[str, str]:
        """Committed batches with the folders of their deltas."""
        where = self._path(f"{self.path}/commits")
        if not self._fs.exists(where):
            return {}
        found = {}
        for status in self._fs.listStatus(where):
            stream = self._fs.open(status.getPath())
            found[status.getPath().getName()] = bytes(stream.readAllBytes()).decode()
            stream.close()
        return dict(sorted(found.items()))

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Apply a batch of signed counts once; False if it was applied before, by this writer or another."""
        if self._fs.exists(self._marker(batch)):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        rows = reduce(DataFrame.unionByName, changes)
        delta = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.write.parquet(f"{self.path}/deltas/{attempt}")
        if self._claim(batch, attempt):
            return True
        self._fs.delete(self._path(f"{self.path}/deltas/{attempt}"), True)
        return False

    def _claim(self, batch: str, attempt: str) -> bool:
        """Put a complete marker in place unless there is one."""
        draft = self._path(f"{self.path}/drafts/{attempt}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(attempt.encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self._files.rename(draft, self._marker(batch), options)
        except Py4JJavaError as e:
            if not self._fs.exists(self._marker(batch)):
                raise
            self._fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def totals(self) -> DataFrame:
        """The sums over all committed batches; groups without documents are left out."""
        paths = [f"{self.path}/deltas/{attempt}" for attempt in self.committed().values()]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return (
            rows.groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
        )
