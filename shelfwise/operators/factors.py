"""Biased matrix factorization: offsets plus ALS factors on what they leave unexplained."""

from __future__ import annotations

import contextvars
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import draw_key
from ..storage import checkpoint_dir, cut, dealt
from .baselines import EPOCHS, Baselines, fit_baselines, predict_baselines
from .sampling import dense_index

# Defaults of the factorization and of its grid search.
RANK = 10
ITERATIONS = 5
REGULARIZATION = 0.1
FOLDS = 5


@dataclass
class Factors:
    """Offsets and the tables (user_id, p) and (product_id, q)."""

    base: Baselines
    users: DataFrame
    items: DataFrame


def _numbered(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        # the factorization takes 32-bit ids only; a larger number fails in the cast
        cut(dense_index(ratings, "user_id", "u").withColumn("u", F.col("u").cast("int"))),
        cut(dense_index(ratings, "product_id", "i").withColumn("i", F.col("i").cast("int"))),
    )


def _als(ratings: DataFrame, target: str, users: DataFrame, items: DataFrame, **options) -> ALSModel:
    return _als_coded(ratings.join(dealt(users), "user_id").join(dealt(items), "product_id"), target, **options)


def _als_coded(coded: DataFrame, target: str, **options) -> ALSModel:
    """ALS on integer ids. Its own lineage is cut in the shared checkpoint folder."""
    spark = coded.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    settings = {"rank": RANK, "maxIter": ITERATIONS, "regParam": REGULARIZATION, "seed": 42} | options
    als = ALS(userCol="u", itemCol="i", ratingCol=target, coldStartStrategy="nan", **settings)
    return als.fit(coded.select("u", "i", target))


def _decoded(model: ALSModel, users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    u = model.userFactors.withColumnsRenamed({"id": "u", "features": "p"})
    i = model.itemFactors.withColumnsRenamed({"id": "i", "features": "q"})
    return (
        cut(dealt(users).join(dealt(u), "u").select("user_id", "p")),
        cut(dealt(items).join(dealt(i), "i").select("product_id", "q")),
    )


def dot(p: Column, q: Column) -> Column:
    """Inner product; 0 when one side is unknown."""
    product = F.aggregate(
        F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return F.coalesce(product, F.lit(0.0))


@dataclass
class Leftover:
    """What the factors explain: (u, i, left) with the numbers of users and products. All settings
    of a search fit to the same one."""

    base: Baselines
    coded: DataFrame
    users: DataFrame
    items: DataFrame


def leftover(ratings: DataFrame, base: Baselines) -> Leftover:
    """Numbers and offsets of an id come by one join for both."""
    users, items = _numbered(ratings)
    by_user = dealt(users).join(dealt(base.users), "user_id", "left")
    by_item = dealt(items).join(dealt(base.items), "product_id", "left")
    rows = ratings.join(dealt(by_user), "user_id").join(dealt(by_item), "product_id")
    b_u, b_i = F.coalesce("b_u", F.lit(0.0)), F.coalesce("b_i", F.lit(0.0))
    left = F.col("score") - (F.lit(base.mean["score"]) + b_u + b_i)
    return Leftover(base, cut(rows.select("u", "i", left.alias("left"))), users, items)


def fit_factors(
    ratings: DataFrame, base: Baselines | None = None, rest: Leftover | None = None, **options
) -> Factors:
    rest = leftover(ratings, fit_baselines(ratings) if base is None else base) if rest is None else rest
    model = _als_coded(rest.coded, "left", **options)
    return Factors(rest.base, *_decoded(model, rest.users, rest.items))


def predict_factors(model: Factors, pairs: DataFrame) -> DataFrame:
    """``pairs`` with raw and est. Of an unknown user or product only its own terms drop out."""
    df = predict_baselines(model.base, pairs)
    df = df.join(dealt(model.users), "user_id", "left").join(dealt(model.items), "product_id", "left")
    df = df.withColumn("raw", F.col("raw") + dot(F.col("p"), F.col("q"))).drop("p", "q")
    return df.withColumn("est", model.base.clip(F.col("raw")))


def nmf_scores(train: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """Non-negative factorization of the scores; the mean where an id is unknown."""
    from .predictors import clip, scale

    mean, _, low, high = scale(train)
    users, items = _numbered(train)
    model = _als(train, "score", users, items, nonnegative=True, **options)
    p, q = _decoded(model, users, items)
    df = pairs.join(dealt(p), "user_id", "left").join(dealt(q), "product_id", "left")
    known = F.col("p").isNotNull() & F.col("q").isNotNull()
    est = F.when(known, dot(F.col("p"), F.col("q"))).otherwise(F.lit(mean))
    return df.withColumn("est", clip(est, low, high)).drop("p", "q")


def best_factors(
    ratings: DataFrame, grid: Iterable[dict], by: str = "rmse", **options
) -> tuple[DataFrame, Factors]:
    """The errors of ``grid_search`` and the model fitted again on all ratings with the setting
    that has the smallest error (the first of equals)."""
    grid = list(grid)
    errors = cut(grid_search(ratings, grid, **options))
    best = errors.orderBy(by, "params").first()["params"]
    chosen = next(g for g in grid if str(sorted(g.items())) == best)
    return errors, fit_factors(ratings, **chosen)


def _side_by_side(pool: ThreadPool, run: Callable, jobs: Iterable) -> list:
    """``run`` for each job. Tables written by a thread count among those of the caller."""
    held = [(contextvars.copy_context(), job) for job in jobs]
    return pool.map(lambda x: x[0].run(run, x[1]), held, chunksize=1)


def grid_search(
    ratings: DataFrame,
    grid: Iterable[dict],
    folds: int = FOLDS,
    epochs: int = EPOCHS,
    seed: int | str = 42,
    parallelism: int = 4,
) -> DataFrame:
    """params, rmse, mae averaged over the folds, and which settings are best by each.

    Fold numbers come from the md5 of each rating's key. Offsets, numbers and what the offsets
    leave are worked out once per fold; folds and fits run side by side and share the cluster.
    """
    grid = list(grid)
    digits = F.conv(F.substring(draw_key(seed, F.col("user_id"), F.col("product_id")), 1, 8), 16, 10)
    ratings = cut(ratings.withColumn("fold", F.pmod(digits.cast("bigint"), F.lit(folds)).cast("int")))

    def prepare(f: int) -> Leftover:
        train = ratings.where(F.col("fold") != f)
        return leftover(train, fit_baselines(train, epochs=epochs))

    def one(job: tuple[int, int]) -> tuple[int, int, float, float]:
        g, f = job
        model = fit_factors(ratings.where(F.col("fold") != f), rest=rests[f], **grid[g])
        found = predict_factors(model, ratings.where(F.col("fold") == f))
        gap = F.col("score") - F.col("est")
        row = found.agg(F.sqrt(F.avg(gap * gap)), F.avg(F.abs(gap))).first()
        return g, f, row[0], row[1]

    with ThreadPool(parallelism) as pool:
        rests = _side_by_side(pool, prepare, range(folds))
        rows = _side_by_side(pool, one, [(g, f) for g in range(len(grid)) for f in range(folds)])
    spark = ratings.sparkSession
    errors = spark.createDataFrame(
        [(str(sorted(grid[g].items())), f, r, m) for g, f, r, m in rows],
        "params string, fold int, rmse double, mae double",
    )
    out = errors.groupBy("params").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    low = out.agg(F.min("rmse").alias("r"), F.min("mae").alias("m")).first()
    return out.withColumns(
        {"best_rmse": F.col("rmse") == F.lit(low["r"]), "best_mae": F.col("mae") == F.lit(low["m"])}
    )
