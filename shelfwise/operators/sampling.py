"""Exact-size sampling, distributed dense numbering and random picks, all repeatable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import draw_key
from ..storage import cut

# First hexadecimal digits of the md5 that choose a bucket: 16 ** 4 buckets at most.
BUCKET_DIGITS = 4


def sample_fraction(df: DataFrame, keys: list[str], fraction: float, seed: int | str) -> DataFrame:
    """Exactly round(fraction * n) rows: those with the smallest md5 of seed and key.

    Keys must be unique. No global sort: a histogram over at most 65,536 hash buckets says which
    buckets are in or out as a whole; only the bucket on the border is ranked.
    """
    drawn = df.withColumn("__h", draw_key(seed, *[F.col(k) for k in keys])).withColumn(
        "__b", F.substring("__h", 1, BUCKET_DIGITS)
    )
    counts = drawn.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # The histogram has a fixed largest size, so one task and a broadcast are enough for it.
    upto = F.sum("__n").over(Window.orderBy("__b"))
    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    plan = counts.select(
        "__b",
        (F.bround(F.lit(fraction) * total) - (upto - F.col("__n"))).alias("__room"),
        "__n",
    ).where(F.col("__room") > 0)
    kept = drawn.join(F.broadcast(plan), "__b")
    whole = kept.where(F.col("__room") >= F.col("__n"))
    border = kept.where(F.col("__room") < F.col("__n")).withColumn(
        "__rn", F.row_number().over(Window.partitionBy("__b").orderBy("__h"))
    )
    border = border.where(F.col("__rn") <= F.col("__room")).drop("__rn")
    return whole.unionByName(border).drop("__h", "__b", "__room", "__n")


def dense_index(values: DataFrame, column: str, index: str = "idx", ranges: int = 256) -> DataFrame:
    """Distinct values of ``column``, sorted, numbered from 0 without gaps.

    Borders come from a bounded sample of the values, so each range holds a small share of them;
    a value's number is its rank in its range plus the sizes of the ranges before.
    """
    distinct = cut(values.select(column).distinct())
    borders = (
        distinct.orderBy(draw_key("borders", F.col(column)))
        .limit(ranges - 1)
        .agg(F.array_sort(F.collect_list(column)).alias("b"))
        .scalar()
    )
    placed = distinct.withColumn("__b", borders).select(
        column,
        F.size(F.filter("__b", lambda x: x <= F.col(column))).alias("__range"),
    )
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__range",
        (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"),
    )
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    return placed.join(F.broadcast(offsets), "__range").select(
        column, (F.col("__before") + rank).cast("bigint").alias(index)
    )


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by the number of its value in sorted order, column by column."""
    coded = df
    for c in columns:
        numbers = dense_index(df, c, f"__{c}")
        coded = coded.join(numbers, c).drop(c).withColumnRenamed(f"__{c}", c)
    return coded


def pick_per_group(df: DataFrame, group: list[str], key: str, k: int, seed: int | str) -> DataFrame:
    """k repeatable random rows of each group; each task passes on at most k per group."""
    h = draw_key(seed, *[F.col(g) for g in group], F.col(key))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(h))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= k).drop("__rn")
