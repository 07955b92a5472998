"""Points with vectors and payload: reading, lookup, upsert, truncation and search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import first_of, tokens
from .knn import knn_join, unit_vectors
from .text import dealt

# Stored vector length and number of search results.
DIMENSIONS = 128
RESULTS = 10


def dedupe_points(batches: list[DataFrame], order: list[str], point_id: str = "point_id") -> DataFrame:
    """One table of all batches; of repeated ids the first by ``order`` stays.

    Payloads may differ in their fields: columns are matched by name, absent ones are null.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
    fields = [c for c in every.columns if c != point_id]
    first = every.groupBy(point_id).agg(first_of([F.col(c) for c in order], fields).alias("p"))
    return first.select(point_id, "p.*")


def upsert_latest(stored: DataFrame, arriving: DataFrame, key: str = "product_id", version: str = "version") -> DataFrame:
    """The table after the upsert: per key the row of the highest version. Repeating it changes
    nothing. A missing price is stored as 0."""
    every = stored.unionByName(arriving, allowMissingColumns=True)
    if "price" in every.columns:
        every = every.withColumn(
            "price", F.coalesce(F.col("price").try_cast("double"), F.lit(0.0))
        )
    fields = [c for c in every.columns if c not in (key, version)]
    # Of equal versions the greater text form counts, which a map in the payload has as well.
    row = F.struct(*fields)
    newest = F.max_by(F.struct(F.col(version).alias("v"), row.alias("row")), F.struct(F.col(version), F.to_json(row)))
    return every.groupBy(key).agg(newest.alias("x")).select(key, F.col("x.v").alias(version), "x.row.*")


def vector_lookup(points: DataFrame, requests: DataFrame, field: str) -> DataFrame:
    """For each requested payload value one point that carries it, with its vector."""
    wanted = requests.select(field).distinct()
    hits = points.join(wanted, field, "left_semi")
    first = hits.groupBy(field).agg(
        first_of([F.col("point_id")], ["point_id", "embedding"]).alias("p")
    )
    return first.select(field, "p.*")


def find_vector(points: DataFrame, field: str, value: object) -> DataFrame:
    """One point with the given payload value. The filter reaches the file scan."""
    return points.where(F.col(field) == F.lit(value)).limit(1)


def vector_truncate(points: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """First entries of each vector, not rescaled; shorter vectors are left out."""
    return points.where(F.size("embedding") >= dimensions).withColumn(
        "embedding", F.slice("embedding", 1, dimensions)
    )


def vector_topk(points: DataFrame, queries: DataFrame | None = None, k: int = RESULTS) -> DataFrame:
    """id, rank, neighbor, similarity: the k stored vectors nearest to each query vector."""
    data = unit_vectors(points, "point_id", "embedding")
    asked = data if queries is None else unit_vectors(queries, "point_id", "embedding")
    return knn_join(asked, data, k)


def search_points(points: DataFrame, queries: DataFrame | None = None, k: int = RESULTS) -> DataFrame:
    """id, rank, similarity and the whole found point, its vector and payload, under its columns.

    The points are joined on after the search, which moves only ids and vectors.
    """
    found = vector_topk(points, queries, k)
    return found.withColumnRenamed("neighbor", "point_id").join(points, "point_id")


def product_text(catalog: DataFrame) -> Column:
    return F.concat_ws(
        " ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "category", "type", "description")]
    )


def hashed_vectors(
    catalog: DataFrame,
    dimensions: int = DIMENSIONS,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """point_id, embedding and payload of each product.

    Without a model, terms are hashed by their md5 into ``dimensions`` buckets and the counts are
    scaled to unit length; a product without terms has zeros. A model is passed as ``embed``, a
    column function such as a pandas UDF.
    """
    text = product_text(catalog)
    if embed is not None:
        return catalog.withColumn("embedding", embed(text)).withColumn("point_id", F.col("product_id"))
    number = F.conv(F.substring(F.md5(F.col("term")), 1, 8), 16, 10).cast("bigint") % dimensions
    texts, _ = dealt(catalog, "product_id", text)
    terms = texts.select("product_id", F.explode(tokens(F.col("text"))).alias("term"))
    counts = terms.groupBy("product_id", number.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).cast("double").alias("tf")
    )
    sums = counts.groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "tf"))).alias("__tf"),
        F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("__norm"),
    )
    weight = lambda j: F.coalesce(F.col("__tf")[j] / F.col("__norm"), F.lit(0.0)).cast("float")
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), weight)
    df = catalog.join(sums, "product_id", "left")
    return df.withColumns({"embedding": vector, "point_id": F.col("product_id")}).drop("__tf", "__norm")
