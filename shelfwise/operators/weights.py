"""Search for the four share weights by top-N F1."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import rounded
from .baselines import fit_baselines
from .evaluate import TOP_N, micro_f1, split_by_user

# Bounds of the largest weight and of the ratios between neighbouring weights.
BOUNDS = {"w3": (0.6, 0.9), "r2": (0.2, 1.0), "r4": (0.1, 1.0), "r1": (0.1, 1.0)}


def ratio_weights(df: DataFrame) -> DataFrame:
    """w2 = w3 r2, w4 = w2 r4, w1 = w4 r1; ``valid`` tests w1 < w4 < w2 < w3."""
    df = df.withColumn("w2", F.col("w3") * F.col("r2"))
    df = df.withColumn("w4", F.col("w2") * F.col("r4"))
    df = df.withColumn("w1", F.col("w4") * F.col("r1"))
    ordered = (F.col("w1") < F.col("w4")) & (F.col("w4") < F.col("w2")) & (F.col("w2") < F.col("w3"))
    return df.withColumn("valid", ordered)


def grid(steps: int = 2) -> list[dict[str, float]]:
    """Evenly spaced inner points of the bounds: a fixed, small number of trials."""
    axes = [
        [low + (high - low) * (i + 1) / (steps + 1) for i in range(steps)]
        for low, high in BOUNDS.values()
    ]
    return [dict(zip(BOUNDS, point, strict=True)) for point in itertools.product(*axes)]


def weight_sweep(
    sums: DataFrame,
    truth: DataFrame,
    users: DataFrame,
    trials: list[dict[str, float]] | None = None,
    top_n: int = TOP_N,
) -> DataFrame:
    """weight_id, w1..w4, hits, recommended, actual, precision, recall, f1; -1 for a wrong order.

    Scores and offsets are linear in the weights. The offsets of the four share sums are fitted
    once, together; each trial is then a weighted sum per product. Held-out users are unknown, so
    their products rank by item offset alone.
    """
    spark = sums.sparkSession
    trials = grid() if trials is None else trials
    table = spark.createDataFrame(
        [(i, *[float(t[k]) for k in ("w3", "r2", "r4", "r1")]) for i, t in enumerate(trials)],
        "weight_id int, w3 double, r2 double, r4 double, r1 double",
    )
    table = ratio_weights(table).select("weight_id", "w1", "w2", "w3", "w4", "valid")
    rows = [r.asDict() for r in table.collect()]
    test, train = split_by_user(sums, users)
    shares = ("s1", "s2", "s3", "s4")
    model = fit_baselines(train, shares)
    offsets = test.select("user_id", "product_id").join(model.items, "product_id", "left")
    structs = [
        F.struct(
            F.lit(r["weight_id"]).alias("weight_id"),
            sum(
                (
                    F.lit(r[f"w{i}"]) * (F.lit(model.mean[s]) + F.coalesce(f"b_i_{s}", F.lit(0.0)))
                    for i, s in enumerate(shares, 1)
                ),
                F.lit(0.0),
            ).alias("raw"),
        )
        for r in rows
        if r["valid"]
    ]
    found = F.array(*structs).cast("array<struct<weight_id:int,raw:double>>")
    scored = offsets.select("user_id", "product_id", F.inline(found))
    order = Window.partitionBy("weight_id", "user_id").orderBy(
        F.desc(rounded(F.col("raw"))), "product_id"
    )
    lists = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    found = micro_f1(lists, truth, ("weight_id",))
    return (
        F.broadcast(table)
        .join(found, "weight_id", "left")
        .withColumn("f1", F.when(F.col("valid"), F.coalesce("f1", F.lit(0.0))).otherwise(-1.0))
    )


def best_weights(sweep: DataFrame) -> tuple[float, float, float, float]:
    """Weights of the best trial (the first of equals): one row."""
    row = sweep.orderBy(F.desc("f1"), "weight_id").first()
    return row["w1"], row["w2"], row["w3"], row["w4"]
