"""What the corpus operators share: reading, shared storage and Arrow streaming.

Every operator names the columns it needs and selects only those, so further
columns of a table, whatever their names, never reach it.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python kernel at once; bounds the Python copies of texts.
SLICE = 256


#: Bytes of a batch of rows on its way to Python, where the session leaves Spark's default.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (a
    local session, as in tests) is a temporary folder of this machine used.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = f"file://{tempfile.gettempdir()}/hazardframe"
    return told.rstrip("/")


#: Folders that the operators of this thread have stored, for :func:`scratch`.
_made = threading.local()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared storage; it is removed when the application ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    return path


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    ``tasks`` is the number of tasks that make a table of short rows; it is then
    gathered into far fewer files, as each costs the executors more than its rows.
    """
    path = fresh_path(df.sparkSession, name)
    _made.__dict__.setdefault("paths", []).append(path)
    (df.repartition(max(8, tasks // 64)) if tasks else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, what operators stored inside; their results must have been written by then."""
    paths = _made.__dict__.setdefault("paths", [])
    before = len(paths)
    try:
        yield
    finally:
        while len(paths) > before:
            forget(spark, paths.pop())


def gathered(df: DataFrame) -> DataFrame:
    """``df`` after a shuffle in four tasks a core at most, each working off its partitions one after another.

    It makes fewer output files without moving rows; a task still holds one
    partition's sort or join at a time. Where there are no more partitions than
    that, as on a large cluster, nothing changes.
    """
    spark = df.sparkSession
    n = max(16, 4 * spark.sparkContext.defaultParallelism)
    return df.coalesce(n) if n < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def partitions(df: DataFrame) -> int:
    """Tasks that a scan of ``df`` takes."""
    return df.rdd.getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a task a core at least: the scan of a small table may be a single task. A larger one is not moved."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if partitions(df) >= n else df.repartition(n)


#: Keys of so many rows are frequent, and no more than so many keys are.
FREQUENT, MOST_FREQUENT = 10_000, 50_000


def joined_evenly(rows: DataFrame, table: DataFrame, keys: list[str], count: str, values: list[str], scatter: list[str]) -> DataFrame:
    """``rows`` that ``table`` has the keys of, with its ``values``; no task gathers the rows of a frequent key.

    ``table`` has one row for each of the ``keys`` (bigint) and in ``count`` how many
    rows have them; it is read twice. Keys of more than ``FREQUENT`` rows and more
    than one in ``MOST_FREQUENT`` of all rows, which are fewer than ``MOST_FREQUENT``
    keys, are broadcast; their rows are scattered by the columns ``scatter`` in the
    shuffled join of the others. Null keys match nothing.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(FREQUENT, total // MOST_FREQUENT)
    own, other, moved = (unused(rows, x) for x in ("_own", "_other", "_moved"))
    first, *more = keys
    table = table.select(*(F.col(k).alias(f"{other}{i}") for i, k in enumerate(keys)), count, F.struct(F.lit(True).alias("there"), *values).alias(other))
    often = table.where(F.col(count) > least)
    same = lambda key: reduce(lambda x, y: x & y, [key == F.col(f"{other}0"), *(F.col(k) == F.col(f"{other}{i}") for i, k in enumerate(more, 1))])
    if total > least:
        marked = rows.join(F.broadcast(often.withColumnRenamed(other, own).drop(count)), same(F.col(first)), "left").drop(*(f"{other}{i}" for i in range(len(keys))))
    else:
        marked = rows.withColumn(own, F.lit(None).cast(table.schema[other].dataType))
    # a row is shuffled with its key, or if that is frequent with a scattered one, and then with the key besides
    frequent = F.col(own).isNotNull()
    marked = marked.withColumn(moved, F.when(frequent, F.xxhash64(*scatter)).otherwise(F.col(first))).withColumn(first, F.when(frequent, F.col(first)))
    both = marked.join(table.where(F.col(count) <= least).drop(count), same(F.col(moved)), "left").where(frequent | F.col(other).isNotNull())
    key = F.when(frequent, F.col(first)).otherwise(F.col(moved)).alias(first)
    return both.select(*(key if c == first else F.col(f"`{c}`") for c in rows.columns), *(F.when(frequent, F.col(f"{own}.{v}")).otherwise(F.col(f"{other}.{v}")).alias(v) for v in values))


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage."""
    fs, where = _place(spark, path)
    fs.delete(where, True)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def small_batches(spark: SparkSession) -> None:
    """Long texts fill a default batch with tens of MB on both sides; hold that down."""
    name, default, ours = BATCH_BYTES
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, ours)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_rows(
    df: DataFrame,
    schema: str,
    kernel: Callable[..., dict[str, object]],
    prepare: Callable[[], object] | None = None,
) -> DataFrame:
    """Apply a kernel to slices of rows in Arrow.

    ``kernel`` gets one list per column of ``df`` (and first what ``prepare``
    made once a task, if given) and returns a dict of equally long columns.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (prepare(),) if prepare else ()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = kernel(*state, *(part.column(i).to_pylist() for i in range(len(names))))
                out = _batch(made, target)
                if out.num_rows:
                    yield out

    target = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string, for a kernel about to be planned."""
    small_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(ddl)
    return to_arrow_schema(kind)


def _batch(made: dict[str, object], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(made[f.name], type=f.type) for f in target], schema=target
    )
