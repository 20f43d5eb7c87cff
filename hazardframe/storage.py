"""The folder that driver and executors share: cutting the lineage of a table, and places to write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _told(spark: SparkSession) -> str | None:
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return told


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder there, removed when the application ends; a local session without one uses a temporary folder."""
    path = f"{(_told(spark) or f'file://{tempfile.gettempdir()}/hazardframe').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to ``spark.checkpoint.dir``; a local session without one uses a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_told(df.sparkSession) or f"file://{tempfile.mkdtemp(prefix='hazardframe-')}")
    return df.checkpoint()
