"""Shared working storage: where lineage is cut and intermediate tables are kept."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def working_tables(spark: SparkSession):
    """Deletes at the end the tables that ``cut`` has written inside. Results must be consumed
    or written before."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table. ``options`` are
    those of the writer.

    The result no longer depends on the executors that made it, later readers do not repeat
    the work, and the planner knows its size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, *keys: str):
    """``df`` as a table dealt into buckets of ``keys``, for joins that repeat: only the other side
    is then shuffled. The table is dropped and its files are deleted at the end."""
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        remove(spark, path)


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Hash the rows over all cores for work that grows far beyond its input bytes.

    Adaptive execution sizes tasks by bytes, which would leave such work to a few tasks. ``least``
    is the number of parts that keeps each of them small.
    """
    spark = df.sparkSession
    n = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least
    )
    return df.repartition(n, *keys)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals out both. For tables with a row per user or product: their
    files are small beside their rows, so that the planner would gather them on the driver to broadcast
    them, and jobs side by side would hold several at once."""
    return df.hint("merge")
