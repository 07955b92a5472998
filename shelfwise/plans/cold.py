"""Recommendations for unknown and anonymous users: cluster lists, then similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.coldstart import TOP_N, cluster_for_target
from ..operators.names import LIST_SIZE, similar_names
from ..operators.sampling import pick_per_group
from ..storage import cut

# Fixed value: random picks from the second list.
OTHERS_TAKEN = 2


def cluster_lists(
    requests: DataFrame, clusters: DataFrame, seed: int | str = 42, chosen: DataFrame | None = None
) -> DataFrame:
    """target, bucket, pos, product_id: up to 8 of ``top`` and 2 random ones of ``others``.

    With ``chosen`` (target, cluster), ``clusters`` need only hold the chosen ones.
    """
    chosen = cluster_for_target(clusters, requests) if chosen is None else chosen
    chosen = chosen.where(F.col("cluster").isNotNull())
    members = clusters.select(F.col("target").alias("cluster"), "bucket", "rank", "candidate")
    listed = chosen.join(members, "cluster").where(
        F.col("candidate").isNotNull() & (F.col("candidate") != F.col("target"))
    )
    top = listed.where((F.col("bucket") == "top") & (F.col("rank") <= TOP_N))
    rest = listed.where(F.col("bucket") == "others")
    rest = pick_per_group(rest, ["target"], "candidate", OTHERS_TAKEN, seed)
    order = Window.partitionBy("target", "bucket").orderBy("rank")
    return (
        top.unionByName(rest)
        .withColumn("pos", F.row_number().over(order))
        .select("target", "bucket", "pos", F.col("candidate").alias("product_id"))
    )


def cold_recommend(
    requests: DataFrame,
    clusters: DataFrame,
    details: DataFrame,
    others_first: bool = False,
    final_cut: bool = True,
    size: int = LIST_SIZE,
    seed: int | str = 42,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """target, rank, product_id, source and details. Depends on the product only, so equal
    requests are answered once and joined back by the caller. ``details`` need only hold the
    products of the requested ones' categories and brands."""
    wanted = requests.select("product_id").distinct()
    lists = cut(cluster_lists(wanted, clusters, seed, chosen))
    taken = lists.groupBy("target").agg(F.collect_list("product_id").alias("excluded"))
    targets = wanted.select(F.col("product_id").alias("target")).join(taken, "target", "left")
    targets = targets.withColumn(
        "excluded", F.coalesce("excluded", F.array().cast("array<string>"))
    ).withColumn("needed", F.greatest(F.lit(size) - F.size("excluded"), F.lit(0)))
    fill = similar_names(targets, details)
    tier = {"others": 0, "top": 1} if others_first else {"top": 0, "others": 1}
    every = lists.select(
        "target", F.col("bucket").alias("source"), "pos", "product_id"
    ).unionByName(
        fill.select("target", F.lit("similar").alias("source"), F.col("rank").alias("pos"), "product_id")
    )
    every = every.withColumn(
        "tier",
        F.when(F.col("source") == "similar", 2)
        .when(F.col("source") == "top", tier["top"])
        .otherwise(tier["others"]),
    )
    order = Window.partitionBy("target").orderBy("tier", "pos")
    ranked = every.withColumn("rank", F.row_number().over(order)).drop("tier", "pos")
    if final_cut:
        ranked = ranked.where(F.col("rank") <= size)
    return ranked.join(details, "product_id", "left")


def anonymous_recommend(requests: DataFrame, clusters: DataFrame, details: DataFrame, **options) -> DataFrame:
    """As for unknown users, but random picks come first and there is no final cut."""
    return cold_recommend(requests, clusters, details, others_first=True, final_cut=False, **options)
