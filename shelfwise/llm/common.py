"""Helpers shared by the operators: reading, written working tables, bounded slices of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.storage import cut


#: Rows in an Arrow batch: texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = "1500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; the shuffles that made it may then be dropped.

    Spark deletes shuffle files when the driver collects the plans that refer to them, so the
    driver is asked to; without it they stay on the executors' disks until the job ends.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    out = cut(df, compression="zstd")
    for _ in range(2):  # the first time frees the plan, the second time what it held
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete working tables that nothing will read any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name clashes with those of working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks of all operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(column: pa.Array, most: int = 1 << 19, trim: bool = True) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about ``most`` bytes each; a long text stands alone.
    After the last one the memory that they took is given back, if ``trim`` is set."""
    if not len(column):
        return
    ends = string_offsets(column)[1:].astype("int64")
    start, base = 0, int(string_offsets(column)[0])
    while start < len(column):
        stop = int(ends.searchsorted(base + most, side="right"))
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        base = int(ends[stop - 1])
        start = stop
    if trim:
        give_back()


def gathered(batches: Iterator[pa.RecordBatch], most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts have about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        own = batch.column(batch.schema.get_field_index(name)).nbytes
        if held and size + own > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


def string_offsets(column: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1]


def string_bytes(column: pa.Array):
    """The bytes of all texts of a column without nulls, and each text's offsets in them."""
    import numpy as np

    offsets = string_offsets(column).astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("")
