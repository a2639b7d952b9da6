"""Reuse of results that several branches read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it has ended; those that kept tables come from stay.

    For queries whose result is collected or written: nothing is made again from them. A table made outside has its own mind: select from it inside.
    """
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)


def reuse(df: DataFrame) -> DataFrame:
    """Keep ``df`` while several branches read it; blocks of lost executors are made again.

    The caller may release it with ``unpersist``. Its rows must not depend on partitions.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quaver-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a checkpoint: plan and lineage end here, so that many later jobs plan quickly.

    The folder is the one named by ``spark.checkpoint.dir``; only a local session without one gets a folder of its own.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like :func:`settled` for rows with texts, as a compressed table in the same folder, for :func:`dropped`; what it was shuffled from goes."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/rows-{uuid.uuid4().hex}"
    with swept(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def dropped(table: DataFrame) -> None:
    """Delete a table of :func:`written` that no later step reads."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
