"""Sums over pairs of items that share a key: the one join behind co-occurrence, session
candidates and average rating differences.

A plain self join puts all pairs of one key in one task. Here every key's items are cut into chunks
of bounded size, and two chunks of a key meet in a unit of their own; a small key is a single
unit and needs no look at the sizes, which hold the larger keys only. Without a left side each pair is made once and mirrored after it is summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

# Items of a key in one chunk, on average: a unit makes about the square of it in pairs.
CHUNK = 1024

_SUMS = ["n", "sx", "sy", "sxy", "sd2"]


def _chunks(rows: DataFrame, chunk: int, name: str) -> DataFrame:
    """Number of chunks of the keys that have more than one."""
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > chunk)
    return counts.select("k", F.ceil(F.col("c") / chunk).cast("int").alias(name))


def _of(chunks: str) -> Column:
    return F.pmod(F.xxhash64("i"), F.col(chunks)).cast("int")


def _all(chunks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))


def pair_sums(
    rows: DataFrame,
    key: str,
    item: str,
    value: str | None = None,
    left: DataFrame | None = None,
    chunk: int = CHUNK,
    written: bool = False,
) -> DataFrame:
    """Ordered pairs a != b with n, sx, sy, sxy, sd2 over the keys that hold both items.

    ``rows`` must be distinct on (key, item). sx adds up a's values, sy those of b, sd2 their
    squared differences. ``left`` restricts the a side to its (key, item) rows. A row is copied
    once for each chunk of the other side. ``written`` says that both tables are, so that reading
    them twice repeats no work.
    """

    def shaped(df: DataFrame) -> DataFrame:
        v: Column = F.col(value).cast("double") if value and value in df.columns else F.lit(1.0)
        df = df.select(F.col(key).alias("k"), F.col(item).alias("i"), v.alias("v"))
        return df if written else cut(df)

    b_rows = shaped(rows)
    a_rows = b_rows if left is None else shaped(left)
    b_chunks = _chunks(b_rows, chunk, "cb")
    if left is None:
        sizes = b_chunks.withColumn("ca", F.col("cb"))
    else:
        sizes = _chunks(a_rows, chunk, "ca").join(b_chunks, "k", "full")
    sizes = cut(sizes.select("k", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("ca", "cb")]))
    unit = ["k"]
    if not sizes.isEmpty():
        unit = ["k", "u", "w"]

        def dealt(df: DataFrame) -> DataFrame:
            return df.join(sizes, "k", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("ca", "cb")})

        a_rows, b_rows = (
            dealt(a_rows).select("k", "i", "v", _of("ca").alias("u"), _all("cb").alias("w")),
            dealt(b_rows).select("k", "i", "v", _all("ca").alias("u"), _of("cb").alias("w")),
        )
    one = a_rows.select(*unit, F.col("i").alias("a"), F.col("v").alias("x"))
    two = b_rows.select(*unit, F.col("i").alias("b"), F.col("v").alias("y"))
    apart = F.col("a") != F.col("b") if left is not None else F.col("a") < F.col("b")
    gap = F.col("x") - F.col("y")
    sums = one.join(two, unit).where(apart).groupBy("a", "b").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(gap * gap).alias("sd2"),
    )
    if left is not None:
        return sums
    both = F.array(
        F.struct("a", "b", *_SUMS),
        F.struct(
            F.col("b").alias("a"), F.col("a").alias("b"), "n",
            F.col("sy").alias("sx"), F.col("sx").alias("sy"), "sxy", "sd2",
        ),
    )
    return sums.select(F.inline(both))
