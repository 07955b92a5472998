"""Model tables under time-stamped names, and the choice of the newest one."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import ARTIFACT_TIME_FORMAT, artifact_stamp

# Fixed value: model names end in two-digit day, month, year, hour and minute.
STAMP_PATTERN = r"_(\d{2}_\d{2}_\d{2}_\d{2}_\d{2})"

# What may follow the time in the names of our own models: nothing, or a version.
VERSION_PATTERN = r"(?:-[0-9a-f]+)?$"


def name_time(name: Column, prefix: Column, suffix: str = r"\.pkl") -> Column:
    """Time in a model name, null where there is none or it is no valid time."""
    pattern = F.concat(F.lit(r"\Q"), prefix, F.lit(r"\E" + STAMP_PATTERN + suffix))
    stamp = F.call_function("regexp_extract", name, pattern, F.lit(1))
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(ARTIFACT_TIME_FORMAT))


def latest_artifact(names: DataFrame, wanted: DataFrame, suffix: str = r"\.pkl") -> DataFrame:
    """prefix, name: newest by the time in the name; else the largest name; else the default.

    ``names`` has a ``name`` column; ``wanted`` has ``prefix`` and ``default_name``.
    """
    # One prefix per kind of model: a handful of rows, whatever the number of stored models.
    hit = F.col("name").startswith(F.col("prefix"))
    found = names.select("name").join(F.broadcast(wanted.select("prefix")), hit).withColumn(
        "at", name_time(F.col("name"), F.col("prefix"), suffix)
    )
    newest = F.max_by("name", F.when(F.col("at").isNotNull(), F.struct("at", "name")))
    best = found.groupBy("prefix").agg(newest.alias("newest"), F.max("name").alias("largest"))
    return wanted.join(best, "prefix", "left").select(
        "prefix", F.coalesce("newest", "largest", "default_name").alias("name")
    )


def stamped_name(spark: SparkSession, prefix: str, at: str | None = None) -> str:
    """``<prefix>_dd_MM_yy_HH_mm`` in the zone model names use; ``at`` is a UTC time."""
    ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return f"{prefix}_{spark.range(1).select(artifact_stamp(ts)).first()[0]}"


def new_name(spark: SparkSession, prefix: str, at: str | None = None) -> str:
    """A stamped name with a version that grows with every call, so that no two models share a
    name and the later of one minute is the newer one."""
    return f"{stamped_name(spark, prefix, at)}-{time.time_ns():016x}{uuid.uuid4().hex[:6]}"


def write_model(df: DataFrame, root: str, prefix: str, at: str | None = None) -> str:
    """Write a model table under a new name and return the name."""
    name = new_name(df.sparkSession, prefix, at)
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{name}")
    return name


def read_model(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def announced(spark: SparkSession, root: str) -> DataFrame:
    """Names of the finished models below ``root``, as announced in its ``artifacts`` table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/artifacts")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "prefix string, name string")
    return spark.read.schema("prefix string, name string").json(f"{root.rstrip('/')}/artifacts")


def announce(spark: SparkSession, root: str, models: dict[str, str]) -> None:
    """Tell readers about new models. One short row per model, written after the models."""
    rows = spark.createDataFrame(list(models.items()), "prefix string, name string")
    rows.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/artifacts")


def read_latest(spark: SparkSession, root: str, prefix: str, default: str | None = None) -> DataFrame:
    wanted = spark.createDataFrame([(prefix, default or prefix)], "prefix string, default_name string")
    row = latest_artifact(announced(spark, root), wanted, suffix=VERSION_PATTERN).first()
    return read_model(spark, root, row["name"])
