"""Rating predictors compared with each other: neighbours, slopes, a random draw, co-clusters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import draw_key
from ..storage import cut
from .baselines import Baselines, fit_baselines, predict_baselines, rating_errors
from .pairs import CHUNK, pair_sums
from .raters import rating_neighbors
from .sampling import sample_fraction

# Usual defaults of the predictors.
USER_CLUSTERS = 3
ITEM_CLUSTERS = 3
CLUSTER_EPOCHS = 20
TEST_SHARE = 0.2
TEST_SEED = 7


def split_ratings(
    ratings: DataFrame, share: float = TEST_SHARE, seed: int | str = TEST_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test): an exact share of the (user, product) ratings is set aside."""
    ratings = cut(ratings)
    test = cut(sample_fraction(ratings, ["user_id", "product_id"], share, seed))
    return cut(ratings.join(test, ["user_id", "product_id"], "left_anti")), test


def scale(train: DataFrame) -> tuple[float, float, float, float]:
    """mean, deviation, smallest and largest score of the training ratings: one row."""
    row = train.agg(
        F.avg("score").alias("m"), F.stddev_pop("score").alias("s"),
        F.min("score").alias("lo"), F.max("score").alias("hi"),
    ).first()
    return row["m"], row["s"], row["lo"], row["hi"]


def clip(est: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(est, F.lit(low)), F.lit(high))


def neighbor_sums(near: DataFrame) -> DataFrame:
    """user_id, product_id, w: the sum of the similarities; and for each value of the neighbours that
    ``near`` holds its sum weighted by them, as sim_<name>. All neighbour models follow from these."""
    values = [c for c in near.columns if c not in ("user_id", "product_id", "other", "sim")]
    return near.groupBy("user_id", "product_id").agg(
        F.sum("sim").alias("w"), *[F.sum(F.col("sim") * F.col(c)).alias(f"sim_{c}") for c in values]
    )


def _sums(near: DataFrame) -> DataFrame:
    return near if "w" in near.columns else neighbor_sums(near)


def _from_neighbors(test: DataFrame, sums: DataFrame, shift: str, value: Column) -> DataFrame:
    """Weighted mean ``value`` of the neighbours, added to the column ``shift`` of ``test``."""
    means = sums.select("user_id", "product_id", value.alias("mean"))
    return test.join(means, ["user_id", "product_id"], "left").withColumn(
        "est", F.col(shift) + F.coalesce("mean", F.lit(0.0))
    )


def _finish(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.select("user_id", "product_id", "score", clip(F.col("est"), low, high).alias("est"))


def knn_basic(train: DataFrame, test: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the neighbours' scores; the overall mean where there are none.

    ``near`` are rows of ``rating_neighbors`` or their ``neighbor_sums``, here and below.
    """
    near = rating_neighbors(train, test) if near is None else near
    mean, _, low, high = scale(train)
    sums = _sums(near).select("user_id", "product_id", (F.col("sim_score") / F.col("w")).alias("est"))
    df = test.join(sums, ["user_id", "product_id"], "left")
    return _finish(df.withColumn("est", F.coalesce("est", F.lit(mean))), low, high)


def _user_means(train: DataFrame, name: str, key: str = "user_id") -> DataFrame:
    return train.groupBy(F.col("user_id").alias(key)).agg(F.avg("score").alias(name))


def _known(test: DataFrame, train: DataFrame, mean: float) -> DataFrame:
    """Test ratings with ``base``: the user's mean, or the overall mean of an unknown id."""
    items = train.select("product_id").distinct().withColumn("known", F.lit(True))
    df = test.join(_user_means(train, "m"), "user_id", "left").join(items, "product_id", "left")
    both = F.col("known").isNotNull() & F.col("m").isNotNull()
    return df.withColumn("base", F.when(both, F.col("m")).otherwise(F.lit(mean))).drop("m", "known")


def knn_means(train: DataFrame, test: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """The same on scores centred by each user's mean."""
    near = rating_neighbors(train, test) if near is None else near
    mean, _, low, high = scale(train)
    if not {"mean", "sim_mean"} & set(near.columns):
        near = near.join(_user_means(train, "mean", "other"), "other")
    value = (F.col("sim_score") - F.col("sim_mean")) / F.col("w")
    df = _from_neighbors(_known(test, train, mean), _sums(near), "base", value)
    return _finish(df, low, high)


def knn_baseline(
    train: DataFrame, test: DataFrame, near: DataFrame | None = None, model: Baselines | None = None
) -> DataFrame:
    """The same on scores centred by mean and offsets."""
    model = fit_baselines(train) if model is None else model
    near = rating_neighbors(train, test, carry=model.users) if near is None else near
    mean, _, low, high = scale(train)
    if not {"b_u", "sim_b_u"} & set(near.columns):
        near = near.join(model.users.withColumnsRenamed({"user_id": "other"}), "other")
    sums = _sums(near).join(model.items, "product_id")
    gap = (F.col("sim_score") - F.col("sim_b_u")) / F.col("w") - (F.lit(mean) + F.col("b_i"))
    based = predict_baselines(model, test.select("user_id", "product_id", "score"))
    return _finish(_from_neighbors(based, sums, "raw", gap), low, high)


def slope_one(train: DataFrame, test: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """User mean plus the mean, over the user's products, of the average score difference between
    the test product and each of them."""
    mean, _, low, high = scale(train)
    sums = pair_sums(train, "user_id", "product_id", "score", chunk=chunk)
    slopes = cut(
        sums.select(
            F.col("a").alias("product_id"), F.col("b").alias("rated"),
            ((F.col("sx") - F.col("sy")) / F.col("n")).alias("dev"),
        )
    )
    rated = train.select("user_id", F.col("product_id").alias("rated"))
    devs = (
        test.select("user_id", "product_id")
        .join(rated, "user_id")
        .join(slopes, ["product_id", "rated"])
        .groupBy("user_id", "product_id")
        .agg(F.avg("dev").alias("dev"))
    )
    df = _known(test, train, mean).join(devs, ["user_id", "product_id"], "left")
    return _finish(df.withColumn("est", F.col("base") + F.coalesce("dev", F.lit(0.0))), low, high)


def normal_predictor(train: DataFrame, test: DataFrame, seed: int | str = 42) -> DataFrame:
    """A draw from the normal distribution of the training scores.

    Two uniform numbers come from the md5 of seed and key, so a repeated task draws the same.
    """
    mean, dev, low, high = scale(train)
    key = draw_key(seed, F.col("user_id"), F.col("product_id"))

    def uniform(start: int) -> Column:
        digits = F.conv(F.substring(key, start, 8), 16, 10).cast("bigint")
        return (digits + 1) / F.lit(2.0**32 + 1)

    z = F.sqrt(-2 * F.log(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(9))
    return _finish(test.withColumn("est", F.lit(mean) + F.lit(dev) * z), low, high)


def coclustering(
    train: DataFrame,
    test: DataFrame,
    epochs: int = CLUSTER_EPOCHS,
    user_clusters: int = USER_CLUSTERS,
    item_clusters: int = ITEM_CLUSTERS,
    seed: int | str = 42,
) -> DataFrame:
    """Co-cluster mean plus the user's and the product's offset from their clusters' means.

    The numbers of clusters are fixed, so cluster means are a handful of numbers. Each epoch
    assigns users, then products, to the cluster with the least squared error, rounded to nine
    places, the first of equal ones. The errors for all clusters of a row are summed side by side
    in one aggregation, and the assignments are written to cut the plan. Each product carries its
    sums by user cluster, from which the next cluster means follow: the ratings are read twice an
    epoch. When nobody moves, further epochs would repeat the same state.
    """
    mean, _, low, high = scale(train)
    ratings = cut(train.select("user_id", "product_id", "score"))

    def start(key: str, name: str, n: int) -> DataFrame:
        ids = ratings.groupBy(key).agg(F.avg("score").alias(f"mean_{name}"))
        pick = F.pmod(F.conv(F.substring(draw_key(seed, F.col(key)), 1, 8), 16, 10).cast("bigint"), F.lit(n))
        return cut(ids.withColumn(name, pick.cast("int")))

    users, items = start("user_id", "g", user_clusters), start("product_id", "h", item_clusters)

    def by_cluster() -> list[Column]:
        """A product's sum and number of scores for each user cluster."""
        own = [F.when(F.col("g") == c, F.col("score")) for c in range(user_clusters)]
        return [x for c, v in enumerate(own) for x in (F.sum(v).alias(f"s{c}"), F.count(v).alias(f"n{c}"))]

    def tables() -> tuple[dict, dict, dict]:
        """Mean score per cell, user cluster and product cluster, from one small result."""
        cell = F.inline(
            F.array(*[F.struct(F.lit(c).alias("g"), F.col(f"s{c}").alias("s"), F.col(f"n{c}").alias("n"))
                      for c in range(user_clusters)])
        )
        cells = items.select("h", cell).where(F.col("n") > 0)
        rows = cells.groupBy("g", "h").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("g", "h").collect()
        out = []
        for by in (("g", "h"), ("g",), ("h",)):
            sums: dict[tuple, list[float]] = {}
            for r in rows:
                total = sums.setdefault(tuple(r[b] for b in by), [0.0, 0.0])
                total[0] += r["s"]
                total[1] += r["n"]
            out.append({k: total / n for k, (total, n) in sums.items()})
        return out[0], out[1], out[2]

    def pick(table: dict, *keys: Column) -> Column:
        """At most user_clusters * item_clusters cases."""
        out = F.lit(mean)
        for key, value in table.items():
            test_ = F.lit(True)
            for k, c in zip(key, keys, strict=True):
                test_ = test_ & (c == F.lit(k))
            out = F.when(test_, F.lit(value)).otherwise(out)
        return out

    def estimate(t: tuple, g: Column, h: Column) -> Column:
        cell, by_g, by_h = t
        return (
            pick(cell, g, h)
            + (F.col("mean_g") - pick(by_g, g))
            + (F.col("mean_h") - pick(by_h, h))
        )

    def assign(key: str, name: str, n: int, t: tuple) -> DataFrame:
        joined = ratings.join(users, "user_id").join(items.select("product_id", "mean_h", "h"), "product_id")
        errors = []
        for c in range(n):
            g, h = (F.lit(c), F.col("h")) if name == "g" else (F.col("g"), F.lit(c))
            gap = F.col("score") - estimate(t, g, h)
            errors.append(F.struct(F.round(F.sum(gap * gap), 9).alias("e"), F.lit(c).alias("c")))
        best = joined.groupBy(key).agg(
            F.array_min(F.array(*errors))["c"].alias("__new"),
            F.any_value(f"mean_{name}").alias(f"mean_{name}"),
            F.any_value(name).alias("__old"),
            *(by_cluster() if name == "h" else []),
        )
        moved = (F.col("__new") != F.col("__old")).alias("moved")
        return cut(best.withColumns({name: F.col("__new"), "moved": moved}).drop("__new", "__old"))

    started = ratings.join(users, "user_id").join(items, "product_id").groupBy("product_id")
    items = cut(items.join(started.agg(*by_cluster()), "product_id"))
    for _ in range(epochs):
        t = tables()
        users = assign("user_id", "g", user_clusters, t)
        items = assign("product_id", "h", item_clusters, t)
        still = users.where("moved").isEmpty() and items.where("moved").isEmpty()
        users, items = users.drop("moved"), items.drop("moved")
        if still:
            break
    t = tables()
    df = test.join(users, "user_id", "left")
    df = df.join(items.select("product_id", "mean_h", "h"), "product_id", "left")
    est = (
        F.when(F.col("g").isNotNull() & F.col("h").isNotNull(), estimate(t, F.col("g"), F.col("h")))
        .otherwise(F.coalesce("mean_g", "mean_h", F.lit(mean)))
    )
    return _finish(df.withColumn("est", est), low, high)


def compare(predictions: dict[str, DataFrame]) -> DataFrame:
    """model, rmse, mae of each named prediction table."""
    out = None
    for name, df in predictions.items():
        row = rating_errors(df).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def model_compare(train: DataFrame, test: DataFrame, epochs: int = CLUSTER_EPOCHS) -> DataFrame:
    """Errors of the nine predictors on the ratings set aside. Shared parts are built once."""
    from .factors import fit_factors, nmf_scores, predict_factors

    base = fit_baselines(train)
    near = cut(neighbor_sums(rating_neighbors(train, test, carry=base.users)))
    models: dict[str, Callable[[], DataFrame]] = {
        "svd": lambda: predict_factors(fit_factors(train, base), test),
        "knnbasic": lambda: knn_basic(train, test, near),
        "knnwithmeans": lambda: knn_means(train, test, near),
        "knnbaseline": lambda: knn_baseline(train, test, near, base),
        "normalpredictor": lambda: normal_predictor(train, test),
        "baselineonly": lambda: predict_baselines(base, test),
        "nmf": lambda: nmf_scores(train, test),
        "slopeone": lambda: slope_one(train, test),
        "coclustering": lambda: coclustering(train, test, epochs),
    }
    return compare({name: make() for name, make in models.items()})
