"""The driver tables seen as this library's inputs. The DuckDB text is in ``oracles.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def behaviors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    p = table(spark, sf, "part")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    kind = F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type"))
    side = F.when(F.col("p_size") <= 25, "electronics.").otherwise("home.")
    return e.join(p, F.col("p_partkey") == F.col("k")).select(
        F.col("ts").cast("string").alias("eventTime"),
        F.col("ts").cast("timestamp").alias("event_time"),
        kind.alias("event_type"),
        F.col("k").cast("string").alias("product_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.col("user_id"), F.lit("-"), F.col("ts").cast("date")).alias("user_session"),
        F.concat(side, F.lower("p_type")).alias("category_code"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
        "event_id",
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("category"),
        F.col("p_type").alias("type"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.concat(
            "p_name", F.lit(" "), "p_type", F.lit(" size "), F.col("p_size").cast("string")
        ).alias("description"),
    )


def brand_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as (session, item): the order is the basket, the brand is the item."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("user_session"),
        F.col("p_brand").alias("product_id"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("point_id"), "embedding", "label"
    )


def retrain_records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    body = F.to_json(
        F.struct(
            F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time"),
            "event_type",
        )
    )
    value = (
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .when(F.col("event_type") == "signup", F.lit("{bad"))
        .otherwise(body)
    )
    return e.select(
        F.lit("retrain").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        value.cast("binary").alias("value"),
    )


def details(spark: SparkSession, sf: str) -> DataFrame:
    """Name, category and brand of every product, in the form events carry them."""
    p = table(spark, sf, "part")
    side = F.when(F.col("p_size") <= 25, "electronics ").otherwise("home ")
    return p.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        F.concat(side, F.lower("p_type")).alias("category_code"),
        F.col("p_brand").alias("brand"),
    )


def last_touch(spark: SparkSession, sf: str) -> DataFrame:
    """One request per user: the product of the last raw event. User 0 is unknown to any model."""
    last = behaviors(spark, sf).groupBy("user_id").agg(
        F.max_by("product_id", F.struct("event_time", "event_id")).alias("product_id")
    )
    return last.select("user_id", "product_id")
