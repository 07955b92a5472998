"""Content model: the nearest products by catalog text, and its lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.knn import CHUNK_ROWS, knn_join
from ..operators.text import concat_features, tfidf_weights
from ..storage import cut

# Fixed value: neighbours kept per product.
K = 10


def content_neighbors(catalog: DataFrame, k: int = K, chunk: int = CHUNK_ROWS, **limits) -> DataFrame:
    """product_id, rank, rec_product_id, similarity; never the product itself.

    Products with the same weighted terms are compared once: copies share one list of k + 1
    products, from which each drops itself. Of every set of copies only the first k + 1 ids can
    appear in any list.
    """
    docs = concat_features(catalog)
    weights = tfidf_weights(docs, **limits)
    # The vocabulary bounds each array.
    arrays = weights.groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "tf", "weight"))).alias("t")
    )
    empty = F.array().cast("array<struct<idx:int,tf:bigint,weight:double>>")
    vectors = docs.select("product_id").join(arrays, "product_id", "left")
    vectors = vectors.select("product_id", F.coalesce("t", empty).alias("t"))
    text = F.transform("t", lambda x: F.concat_ws(":", x["idx"].cast("string"), x["tf"].cast("string")))
    vectors = cut(vectors.withColumn("key", F.sha2(F.array_join(text, ","), 256)))
    first = vectors.groupBy("key").agg(
        F.min(F.struct("product_id", "t")).alias("x")
    ).select("key", F.col("x.product_id").alias("id"), F.col("x.t").alias("t"))
    classes = cut(
        first.select(
            "key", "id",
            F.transform("t", lambda x: x["idx"]).alias("idx"),
            F.transform("t", lambda x: x["weight"]).alias("val"),
        )
    )
    by_id = Window.partitionBy("key").orderBy("product_id")
    members = vectors.select("key", "product_id").withColumn("n", F.row_number().over(by_id))
    members = members.where(F.col("n") <= k + 1).join(classes.select("key", "id"), "key")
    members = members.select(F.col("id").alias("neighbor"), "product_id")
    found = knn_join(classes, classes, k + 1, chunk)
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "rec_product_id")
    lists = (
        found.drop("rank")
        .join(members, "neighbor")
        .select("id", F.col("product_id").alias("rec_product_id"), "similarity")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k + 1)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "rec_product_id", "similarity"))).alias("recs"))
    )
    lists = lists.join(classes.select("key", "id"), "id").select("key", "recs")
    others = F.slice(
        F.filter("recs", lambda x: x["rec_product_id"] != F.col("product_id")), F.lit(1), F.lit(k)
    )
    per_product = vectors.select("product_id", "key").join(lists, "key")
    return per_product.select("product_id", F.posexplode(others).alias("pos", "rec")).select(
        "product_id",
        (F.col("pos") + 1).alias("rank"),
        "rec.rec_product_id",
        "rec.similarity",
    )


def content_recommend(model: DataFrame, requests: DataFrame, k: int = K) -> DataFrame:
    """Requests with their first k neighbours; an unknown product keeps one row with nulls."""
    wanted = requests.select("product_id").distinct()
    return wanted.join(model.where(F.col("rank") <= k), "product_id", "left").withColumn(
        "found", F.col("rec_product_id").isNotNull()
    )
