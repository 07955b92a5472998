"""Answer a stream of requests with the newest models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.names import GROUP
from ..plans import cart, cold, content, personal, train
from ..sources.artifacts import read_model
from ..sources.keyed import lookup
from ..storage import cut, working_tables

REQUEST = "kind string, request_id string, user_id string, product_id string, cart_items array<string>, k int"
ANSWER = ["request_id", "kind", "status", "rank", "product_id"]


def answer(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """request_id, kind, status, rank, product_id for content, session, anonymous and cart requests.

    Every request has a row: status is "found", or "not found" with null rank and product where
    no model knows the product or no rule applies.

    Requests are rows of one table. Each kind is one join plan over the rows that its keys look
    up in the newest serving tables: event history is not read, and of a table only the folders in
    which the keys lie. A session request of an unknown user is answered from the clusters.
    """
    names = train.current_models(spark, root)
    requests = cut(requests)

    def known_rows(part: str, wanted: DataFrame) -> DataFrame:
        return cut(lookup(spark, f"{root.rstrip('/')}/{names[train.SERVING]}/{part}", wanted))

    def kind(k: str) -> DataFrame:
        return requests.where(F.col("kind") == k)

    def out(df: DataFrame, k: str) -> DataFrame:
        rank = F.col("rank").cast("int").alias("rank")
        return df.select("request_id", F.lit(k).alias("kind"), rank, "product_id")

    asked = kind("content").select("request_id", "product_id")
    found = content.content_recommend(known_rows("near", asked.select("product_id")), asked).where("found")
    found = asked.join(found, "product_id")
    parts = [out(found.select("request_id", "rank", F.col("rec_product_id").alias("product_id")), "content")]

    asked = kind("session").select("request_id", "user_id", F.col("product_id").alias("target"))
    users = known_rows("users", asked.select("user_id"))
    known = asked.join(users, "user_id", "left_semi")
    parts.append(out(known.join(_personal(spark, root, names, known_rows, known, users), ["user_id", "target"]), "session"))

    unknown = asked.join(users, "user_id", "left_anti")
    anonymous = kind("anonymous").select("request_id", F.col("product_id").alias("target"))
    for rows, k, recommend in ((unknown, "session", cold.cold_recommend), (anonymous, "anonymous", cold.anonymous_recommend)):
        targets = rows.select(F.col("target").alias("product_id"))
        chosen, clusters = _clusters(known_rows, targets)
        group = known_rows("details", targets).select(*GROUP)
        listed = recommend(targets, clusters, known_rows("names", group), chosen=chosen)
        parts.append(out(rows.join(listed, "target"), k))

    carts = kind("cart").select(
        F.col("request_id").alias("cart"), "cart_items", F.coalesce("k", F.lit(cart.DEFAULT_K)).alias("k")
    )
    rules = known_rows("rules", carts.select(F.explode("cart_items").alias("handle"))).drop("handle")
    pool = read_model(spark, root, f"{names[train.SERVING]}/pool")
    listed = cart.cart_recommend(rules, carts.where(F.col("cart_items").isNotNull()), pool=pool)
    parts.append(out(listed.withColumnRenamed("cart", "request_id"), "cart"))

    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    every = requests.select("request_id", "kind").join(df, ["request_id", "kind"], "left")
    status = F.when(F.col("product_id").isNull(), "not found").otherwise("found")
    return every.withColumn("status", status).select(*ANSWER)


def _personal(spark: SparkSession, root: str, names: dict, known_rows, known: DataFrame, users: DataFrame) -> DataFrame:
    """The lists of users that the model knows, from the tables of their products and their own."""
    products = known_rows("items", known.select(F.col("target").alias("product_id")))
    targets = products.select(F.col("product_id").alias("target"))
    known = known.select("user_id", "target").distinct().join(users, "user_id").join(targets, "target", "left_semi")
    candidates = known_rows("candidates", targets)
    best = known_rows("best", known.select("user_id"))
    items = known_rows("items", candidates.select("product_id").unionByName(best.select("product_id")))
    base = train.read_collaborative(spark, root, names[train.COLLABORATIVE])
    return personal.personal_lists(cut(known), items, candidates, best, base)


def _clusters(known_rows, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each target's cluster, its own or the smallest-named one that lists it, and those clusters."""
    listed = known_rows("listed", targets).select(F.col("product_id").alias("target"), F.col("cluster").alias("listed"))
    wanted = targets.select(F.col("product_id").alias("target"))
    clusters = known_rows("clusters", wanted.unionByName(listed.select(F.col("listed").alias("target"))))
    own = clusters.select("target", F.col("target").alias("own")).distinct()
    chosen = wanted.distinct().join(own, "target", "left").join(listed, "target", "left")
    return chosen.select("target", F.coalesce("own", "listed").alias("cluster")), clusters


def serve(
    requests: DataFrame,
    root: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Answer each batch with the models announced when it starts."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            with working_tables(df.sparkSession):
                sink(answer(df.sparkSession, root, df), number)

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
