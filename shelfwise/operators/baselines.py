"""Damped user and item offsets around the mean score (alternating least squares)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed, cut, dealt

# Usual defaults of the baseline estimator.
EPOCHS = 10
REG_USER = 15.0
REG_ITEM = 10.0

# Parts of each user's and product's pairs, so that none of them is one task's work.
SALTS = 8

# Passes that run as one job, from one written table of offsets to the next.
PASSES = 5


@dataclass
class Baselines:
    """Mean, range, and the offset tables (user_id, b_u...) and (product_id, b_i...).

    With several score columns, offsets carry one column per score: b_u_<name>, b_i_<name>.
    """

    values: list[str]
    mean: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    users: DataFrame
    items: DataFrame

    def clip(self, est: Column, value: str = "score") -> Column:
        return F.least(F.greatest(est, F.lit(self.low[value])), F.lit(self.high[value]))


def rating_scale(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def fit_baselines(
    ratings: DataFrame,
    values: tuple[str, ...] = ("score",),
    epochs: int = EPOCHS,
    reg_user: float = REG_USER,
    reg_item: float = REG_ITEM,
) -> Baselines:
    """Each pass adds up the other side's offsets over (user, item) pairs: sums combine on the
    map side, so a popular product costs no more than one row per task. Offsets are written after
    every few passes, which bounds the plan and what a lost executor can cost. They are linear in
    the scores, hence several score columns are fitted in the same passes.
    """
    values = list(values)
    ratings = cut(ratings.select("user_id", "product_id", *values))
    facts = ratings.agg(
        *[F.avg(v).alias(f"mean_{v}") for v in values],
        *[F.min(v).alias(f"low_{v}") for v in values],
        *[F.max(v).alias(f"high_{v}") for v in values],
    ).first()
    mean = {v: facts[f"mean_{v}"] or 0.0 for v in values}

    def totals(key: str, reg: float) -> DataFrame:
        return cut(
            ratings.groupBy(key).agg(
                (F.count(F.lit(1)) + F.lit(reg)).alias("__den"),
                *[F.sum(F.col(v) - F.lit(mean[v])).alias(f"__t_{v}") for v in values],
            )
        )

    pairs = ratings.select("user_id", "product_id")
    user_totals, item_totals = totals("user_id", reg_user), totals("product_id", reg_item)

    def offsets(number: int, own: str, sums: DataFrame, name: str, rows: DataFrame, other, key: str, oname: str):
        if other is None:
            joined, minus = sums, {v: F.lit(0.0) for v in values}
        else:
            spread = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            added = rows.join(dealt(spread), [key, "salt"]).groupBy(own).agg(
                *[F.sum(f"{oname}_{v}").alias(f"__o_{v}") for v in values]
            )
            joined, minus = sums.join(dealt(added), own), {v: F.col(f"__o_{v}") for v in values}
        new = joined.select(
            own, *[((F.col(f"__t_{v}") - minus[v]) / F.col("__den")).alias(f"{name}_{v}") for v in values]
        )
        return cut(new) if number % PASSES == 0 or number >= 2 * epochs - 1 else new

    # The pairs are dealt out once by each side, a user's or product's over several buckets; in the
    # passes only offsets and sums move.
    def salted(by: str) -> DataFrame:
        return pairs.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))

    users = items = None
    with (
        bucketed(salted("product_id"), "user_id", "salt") as by_user,
        bucketed(salted("user_id"), "product_id", "salt") as by_item,
    ):
        for n in range(1, 2 * epochs, 2):
            items = offsets(n, "product_id", item_totals, "b_i", by_user, users, "user_id", "b_u")
            users = offsets(n + 1, "user_id", user_totals, "b_u", by_item, items, "product_id", "b_i")
    if values == ["score"]:
        users = users.withColumnRenamed("b_u_score", "b_u")
        items = items.withColumnRenamed("b_i_score", "b_i")
    return Baselines(
        values,
        mean,
        {v: facts[f"low_{v}"] for v in values},
        {v: facts[f"high_{v}"] for v in values},
        users,
        items,
    )


def predict_baselines(model: Baselines, pairs: DataFrame) -> DataFrame:
    """``pairs`` with b_u, b_i, raw (before clipping) and est. Unknown ids add nothing."""
    df = pairs.join(dealt(model.users), "user_id", "left").join(dealt(model.items), "product_id", "left")
    df = df.withColumns({"b_u": F.coalesce("b_u", F.lit(0.0)), "b_i": F.coalesce("b_i", F.lit(0.0))})
    df = df.withColumn("raw", F.lit(model.mean["score"]) + F.col("b_u") + F.col("b_i"))
    return df.withColumn("est", model.clip(F.col("raw")))


def rating_errors(predicted: DataFrame, truth: str = "score", est: str = "est") -> DataFrame:
    gap = F.col(truth) - F.col(est)
    return predicted.agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae")
    )


def model_users(model: Baselines) -> DataFrame:
    return model.users.select("user_id").distinct()
