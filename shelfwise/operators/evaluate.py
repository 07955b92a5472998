"""Hold out users, rank their products, and measure precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import rounded, safe_ratio
from .sampling import sample_fraction

# Purchases that make a user eligible, share held out, ranked products per user.
MIN_PURCHASES = 3
TEST_SHARE = 0.1
TOP_N = 3


def purchases(events: DataFrame) -> DataFrame:
    """Distinct purchased (user_id, product_id): the ground truth."""
    bought = events.where(F.col("event_type") == "purchase")
    return bought.select("user_id", "product_id").distinct()


def eligible_users(events: DataFrame, least: int = MIN_PURCHASES) -> DataFrame:
    counts = purchases(events).groupBy("user_id").agg(F.count(F.lit(1)).alias("total_buy"))
    return counts.where(F.col("total_buy") >= least)


def holdout_users(events: DataFrame, share: float = TEST_SHARE, seed: int | str = 42) -> DataFrame:
    return sample_fraction(eligible_users(events).select("user_id"), ["user_id"], share, seed)


def split_by_user(ratings: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(test ratings of the held-out users, train ratings of all others)."""
    return ratings.join(users, "user_id", "left_semi"), ratings.join(users, "user_id", "left_anti")


def top_n(predicted: DataFrame, n: int = TOP_N, score: str = "raw", group: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Top n products per user. The limit is applied before the shuffle; ties go to the id."""
    order = Window.partitionBy(*group).orderBy(F.desc(rounded(F.col(score))), "product_id")
    return predicted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def micro_f1(recommended: DataFrame, truth: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Hits, recommended, actual and micro precision, recall, F1, over users that have a list.

    Truth of users outside the lists does not count. ``group`` evaluates several models at once.
    """
    g = list(group)
    hit = recommended.join(
        truth.withColumn("__hit", F.lit(1)), ["user_id", "product_id"], "left"
    )
    per_user = hit.groupBy(*g, "user_id").agg(
        F.count(F.lit(1)).alias("r"), F.count("__hit").alias("h")
    )
    actual = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("a"))
    sums = per_user.join(actual, "user_id", "left").groupBy(*g).agg(
        F.coalesce(F.sum("h"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("recommended"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("actual"),
    )
    p = safe_ratio(F.col("hits"), F.col("recommended"))
    r = safe_ratio(F.col("hits"), F.col("actual"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn(
        "f1",
        safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def user_precision(recommended: DataFrame, truth: DataFrame, n: int = TOP_N) -> DataFrame:
    """Per user: hits / min(number of purchases, n)."""
    hits = recommended.join(truth, ["user_id", "product_id"], "left_semi")
    hits = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    actual = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("a"))
    users = recommended.select("user_id").distinct()
    return (
        users.join(actual, "user_id")
        .join(hits, "user_id", "left")
        .select(
            "user_id",
            (F.coalesce("hits", F.lit(0)) / F.least("a", F.lit(n))).alias("precision"),
        )
    )


def sample_purchases(truth: DataFrame, share: float = 0.5, seed: int | str = 123) -> DataFrame:
    return sample_fraction(truth, ["user_id", "product_id"], share, seed)
