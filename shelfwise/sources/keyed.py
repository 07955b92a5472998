"""Tables dealt into folders by a hash of their key, so that a lookup of few keys opens few files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket, about, and buckets of a table at most.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 4096
#: Name of the column of folder numbers.
HASH = "hash_of_key"
#: Rows in a file; a key with more is split over several files of its bucket.
FILE_ROWS = 1_000_000


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> None:
    """Write ``df`` in buckets by ``keys``; their number follows the number of rows and is part of
    the path."""
    rows = df.count()
    buckets = min(MOST_BUCKETS, max(1, math.ceil(rows / bucket_rows)))
    # adaptive execution joins small buckets in a task and splits one that a key has made large
    dealt = df.withColumn(HASH, _bucket(keys, buckets)).hint("rebalance", HASH)
    writer = dealt.write.mode("errorifexists").option("maxRecordsPerFile", FILE_ROWS)
    if rows:  # folders keep no schema of an empty table, a file does
        writer = writer.partitionBy(HASH)
    writer.parquet(f"{path.rstrip('/')}/of={buckets}")


def _names(spark: SparkSession, path: str) -> set[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return {e.getPath().getName() for e in entries}


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The whole table."""
    path = path.rstrip("/")
    buckets = next(n for n in _names(spark, path) if n.startswith("of="))
    return spark.read.parquet(f"{path}/{buckets}").drop(HASH)


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is one of ``wanted``, whose columns are those the table is keyed by.

    Only the folders of the wanted keys' hashes are listed and read, of which there are no more than
    buckets.
    """
    keys = wanted.columns
    path = path.rstrip("/")
    buckets = next(int(n.removeprefix("of=")) for n in _names(spark, path) if n.startswith("of="))
    path = f"{path}/of={buckets}"
    wanted = wanted.distinct()
    numbers = {f"{HASH}={r[0]}" for r in wanted.select(_bucket(keys, buckets)).distinct().collect()}
    there = {n for n in _names(spark, path) if n.startswith(f"{HASH}=")}
    folders = sorted(numbers & there) or sorted(there)[:1]  # one for the columns, if none is wanted
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in folders] or [path])
    return rows.drop(HASH).join(wanted, keys, "left_semi")
