"""Separate keys that hold too many rows for one task from all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hash buckets in which rows are counted to see whether any key can be hot.
BUCKETS = 65_536


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of keys with more than ``limit`` rows).

    The count combines on the map side. When no key is hot, adaptive execution sees the empty
    list and removes both the filter and the whole branch built on the second table.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    hot = hot.select(*keys)
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def none_hot(df: DataFrame, keys: list[str], limit: int) -> bool:
    """True where no key has more than ``limit`` rows, by counts of hash buckets: at most BUCKETS rows
    a task are shuffled. False means that a key may be hot."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) <= limit
