"""Products seen together in sessions, and the cold-start clusters built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import draw_key
from ..schemas import require_columns
from ..storage import cut
from .pairs import CHUNK, pair_sums

# Sizes of the two candidate lists.
TOP_N = 8
RANDOM_N = 5


def cooccurrence(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """target, candidate, freq: number of sessions that hold both. Symmetric, no self pairs."""
    require_columns(events, ["user_session", "product_id"])
    members = events.select("user_session", "product_id").distinct()
    pairs = pair_sums(members, "user_session", "product_id", chunk=chunk)
    return pairs.select(
        F.col("a").alias("target"), F.col("b").alias("candidate"), F.col("n").cast("bigint").alias("freq")
    )


def coldstart_clusters(
    events: DataFrame,
    top_n: int = TOP_N,
    random_n: int = RANDOM_N,
    seed: int | str = 42,
    chunk: int = CHUNK,
) -> DataFrame:
    """target, bucket, rank, candidate, freq of the products of all events."""
    targets = events.select(F.col("product_id").alias("target")).distinct()
    return rank_partners(cut(cooccurrence(events, chunk)), targets, top_n, random_n, seed)


def rank_partners(
    pairs: DataFrame,
    targets: DataFrame,
    top_n: int = TOP_N,
    random_n: int = RANDOM_N,
    seed: int | str = 42,
) -> DataFrame:
    """target, bucket, rank, candidate, freq from the counts of pairs (target, candidate, freq).

    ``top`` holds the most frequent partners, ``others`` a random pick of the rest. The pick is
    the smallest md5 values among partners not in ``top``; these are among the
    top_n + random_n smallest of all partners, so both lists come from limits that are applied
    before the shuffle. A product without partners keeps one row with null candidate.
    """
    by_freq = Window.partitionBy("target").orderBy(F.desc("freq"), "candidate")
    top = pairs.withColumn("rank", F.row_number().over(by_freq)).where(F.col("rank") <= top_n)
    by_draw = Window.partitionBy("target").orderBy("__h", "candidate")
    drawn = pairs.withColumn("__h", draw_key(seed, F.col("target"), F.col("candidate")))
    drawn = drawn.withColumn("rank", F.row_number().over(by_draw)).where(
        F.col("rank") <= top_n + random_n
    )
    others = drawn.join(top.select("target", "candidate"), ["target", "candidate"], "left_anti")
    others = others.withColumn("rank", F.row_number().over(by_draw)).where(F.col("rank") <= random_n)
    columns = ["target", "bucket", F.col("rank").cast("int").alias("rank"), "candidate", "freq"]
    lists = (
        top.withColumn("bucket", F.lit("top"))
        .select(*columns)
        .unionByName(others.withColumn("bucket", F.lit("others")).select(*columns))
    )
    alone = targets.join(lists.select("target"), "target", "left_anti")
    return cut(lists.unionByName(alone, allowMissingColumns=True))


def cluster_for_target(clusters: DataFrame, targets: DataFrame) -> DataFrame:
    """target, cluster: its own cluster, else the smallest-named one that lists it, else null."""
    wanted = targets.select(F.col("product_id").alias("target")).distinct()
    own = clusters.select("target").distinct().withColumn("own", F.col("target"))
    listed = (
        clusters.where(F.col("candidate").isNotNull())
        .groupBy(F.col("candidate").alias("target"))
        .agg(F.min("target").alias("listed"))
    )
    return (
        wanted.join(own, "target", "left")
        .join(listed, "target", "left")
        .select("target", F.coalesce("own", "listed").alias("cluster"))
    )
