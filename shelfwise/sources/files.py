"""Reading event and catalog files, collections of points, and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.vectors import upsert_latest
from ..schemas import require_columns
from .artifacts import announce, announced, read_latest, write_model


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, nrows: int | None = None
) -> DataFrame:
    """A CSV file or folder with a header. Object stores only differ in the path."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df if nrows is None else df.limit(nrows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_trending(trending: DataFrame, path: str) -> None:
    """The catalog with scores under the column names of the exported file."""
    write_csv(trending.withColumnRenamed("product_id", "ProductID"), path)


def read_collection(
    spark: SparkSession, path: str, point_id: str = "point_id", schema: T.StructType | None = None
) -> DataFrame:
    """All points of a stored collection, payload keys as columns, vectors not read.

    Files may carry different payload fields: with a ``schema`` absent ones are null and no
    footer is read ahead; without one the schema is the union of all files'. Of repeated point
    ids the first by the remaining columns stays.
    """
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    require_columns(df, [point_id])
    df = df.select([c for c in df.columns if c not in ("embedding", "vector")])
    rest = [c for c in df.columns if c != point_id]
    return df.groupBy(point_id).agg(F.min(F.struct(*rest)).alias("p")).select(point_id, "p.*")


def write_collection(df: DataFrame, path: str) -> None:
    """Replace a vector table. Files hold ranges of products, so that lookups skip files."""
    ranged = df.repartitionByRange("product_id").sortWithinPartitions("product_id")
    ranged.write.mode("overwrite").parquet(path)


def upsert_collection(
    root: str, arriving: DataFrame, key: str = "product_id", version: str = "version", prefix: str = "vectors"
) -> str:
    """Merge rows into the stored table below ``root`` and return the name of its new version.

    The new version is written beside the old one and then announced, so readers
    (``read_latest(spark, root, prefix)``) see the one or the other as a whole, and a failed or
    repeated upsert does no harm.
    """
    spark = arriving.sparkSession
    known = announced(spark, root).where(F.col("prefix") == prefix)
    table = arriving
    if not known.isEmpty():
        table = read_latest(spark, root, prefix)
    merged = upsert_latest(table, arriving, key, version)
    name = write_model(merged.repartitionByRange(key).sortWithinPartitions(key), root, prefix)
    announce(spark, root, {prefix: name})
    return name
