"""Recommendations for known users from recent sessions and predicted scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import rounded
from ..operators.baselines import Baselines
from ..operators.features import recent_sessions
from ..operators.pairs import CHUNK, pair_sums
from ..storage import cut, spread

# Window in months, list size, and the tier of frequent candidates.
MONTHS = 3
LIST_SIZE = 10
FREQUENT = 3
FREQUENT_TAKEN = 3


def session_candidates(
    events: DataFrame,
    targets: DataFrame,
    months: int = MONTHS,
    chunk: int = CHUNK,
    slice_unit: str = "hour",
) -> DataFrame:
    """target, product_id, appearance_count: event rows of other products in the sessions that
    hold the target, within ``months`` before the target's last event.

    Rows are counted per session and product first. A session that lies inside the target's time
    window adds these counts. Only sessions across a border of a window are cut into time slices: a
    slice inside the window adds its counts again, and the slices across the borders are read row by
    row, so a session that runs for long does not multiply its rows by its products.
    """
    rows = events.select("user_session", "product_id", "event_time").where(F.col("event_time").isNotNull())
    extent = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]

    def counted(df: DataFrame, *keys: str) -> DataFrame:
        times = [F.min("event_time").alias("lo"), F.max("event_time").alias("hi")]
        return cut(df.groupBy(*keys, "product_id").agg(F.count(F.lit(1)).alias("n"), *times))

    def held(spans: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
        """The spans with what of ``keys`` overlaps them, and whether it lies inside."""
        holds = spans.join(counts.groupBy(*keys).agg(*extent), "user_session")
        holds = holds.where((F.col("hi") >= F.col("cutoff")) & (F.col("lo") <= F.col("last_time")))
        return holds.withColumn("whole", (F.col("lo") >= F.col("cutoff")) & (F.col("hi") <= F.col("last_time")))

    def summed(counts: DataFrame, key: str, left: DataFrame) -> DataFrame:
        sums = pair_sums(counts, key, "product_id", "n", left, chunk=chunk, written=True)
        return sums.select(F.col("a").alias("target"), F.col("b").alias("product_id"), F.col("sy").alias("c"))

    counts = counted(rows, "user_session")
    # the last event of a product in a session says all that this needs
    last = counts.select("user_session", "product_id", F.col("hi").alias("event_time"))
    holds = cut(held(recent_sessions(last, targets, months), counts, "user_session"))
    out = summed(counts, "user_session", holds.where("whole").select("user_session", "product_id"))

    torn = cut(holds.where(~F.col("whole")).drop("lo", "hi", "whole"))
    if not torn.isEmpty():
        rows = rows.join(torn.select("user_session").distinct(), "user_session", "left_semi")
        rows = cut(rows.withColumn("part", F.date_trunc(slice_unit, "event_time")))
        counts = counted(rows, "user_session", "part")
        holds = cut(held(torn, counts, "user_session", "part"))

        def keyed(df: DataFrame) -> DataFrame:
            key = F.concat_ws("\u0001", "user_session", F.col("part").cast("string"))
            return cut(df.select(key.alias("key"), "product_id", *[c for c in df.columns if c == "n"]))

        across = holds.where(~F.col("whole")).select(
            F.col("product_id").alias("target"), "user_session", "part", "cutoff", "last_time"
        )
        border = (
            across.join(rows, ["user_session", "part"])
            .where(F.col("event_time").between(F.col("cutoff"), F.col("last_time")))
            .where(F.col("product_id") != F.col("target"))
            .groupBy("target", "product_id")
            .agg(F.count(F.lit(1)).cast("double").alias("c"))
        )
        out = out.unionByName(summed(keyed(counts), "key", keyed(holds.where("whole")))).unionByName(border)
    return out.groupBy("target", "product_id").agg(F.sum("c").cast("bigint").alias("appearance_count"))


def _ranked(df: DataFrame, order: list, limit: int, name: str) -> DataFrame:
    w = Window.partitionBy("target").orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= limit)


def session_lists(
    candidates: DataFrame, events: DataFrame, targets: DataFrame, model: Baselines, size: int = LIST_SIZE
) -> DataFrame:
    """target, recs: up to 3 frequent candidates by count, the others by score, then the best
    products of all. By mean and offsets, the order of products is the same for every user, so
    each target is ranked once. The fill needs no more than 2 * size + 1 products.
    """
    b_i = rounded(F.coalesce("b_i", F.lit(0.0)))
    scored = cut(candidates.join(model.items, "product_id", "left").withColumn("b", b_i))
    by_score = [F.desc("b"), "product_id"]
    often = scored.where(F.col("appearance_count") >= FREQUENT)
    high = _ranked(often, [F.desc("appearance_count"), *by_score], FREQUENT_TAKEN, "r")
    rest = _ranked(scored, by_score, size + FREQUENT_TAKEN, "r").join(
        high.select("target", "product_id"), ["target", "product_id"], "left_anti"
    )
    fields = F.struct("tier", "r", "product_id", "appearance_count")
    lists = (
        high.withColumn("tier", F.lit(0))
        .unionByName(rest.withColumn("tier", F.lit(1)))
        .groupBy("target")
        .agg(F.array_sort(F.collect_list(fields)).alias("found"))
    )
    products = events.select("product_id").distinct().join(model.items, "product_id", "left")
    pool = products.withColumn("b", b_i).orderBy(*by_score).limit(2 * size + 1)
    pool = pool.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("b")).alias("o"), "product_id"))),
            lambda x: F.struct(x["product_id"], F.lit(None).cast("bigint").alias("appearance_count")),
        )
    )
    none = F.array().cast("array<struct<product_id:string,appearance_count:bigint>>")
    short = F.transform("found", lambda x: F.struct(x["product_id"], x["appearance_count"]))
    base = events.select(F.col("product_id").alias("target")).distinct()
    base = base.join(targets.select(F.col("product_id").alias("target")).distinct(), "target", "left_semi")
    df = base.join(lists, "target", "left").withColumn("pool", pool.scalar())
    df = df.withColumn("found", F.slice(F.coalesce(short, none), 1, size))
    taken = F.transform("found", lambda x: x["product_id"])
    fill = F.filter(
        "pool",
        lambda x: (x["product_id"] != F.col("target")) & ~F.array_contains(taken, x["product_id"]),
    )
    return df.select("target", F.slice(F.concat("found", fill), 1, size).alias("recs"))


def session_recommend(
    requests: DataFrame,
    events: DataFrame,
    model: Baselines,
    details: DataFrame,
    months: int = MONTHS,
    size: int = LIST_SIZE,
) -> DataFrame:
    """user_id, target, rank, product_id, predicted_score, appearance_count and details, for users
    the model knows. A product without events gives no rows. ``requests``: user_id, product_id.
    """
    known = cut(
        requests.select("user_id", F.col("product_id").alias("target"))
        .distinct()
        .join(model.users, "user_id")
    )
    targets = known.select(F.col("target").alias("product_id")).distinct()
    candidates = session_candidates(events, targets, months)
    lists = session_lists(candidates, events, targets, model, size)
    # a few bytes a request become a list: they are dealt to all cores first
    df = spread(known.join(lists, "target"), "user_id").select(
        "user_id", "target", "b_u", F.posexplode("recs").alias("pos", "rec")
    )
    df = df.select(
        "user_id", "target", "b_u", (F.col("pos") + 1).alias("rank"), "rec.product_id", "rec.appearance_count"
    ).join(model.items, "product_id", "left")
    raw = F.lit(model.mean["score"]) + F.col("b_u") + F.coalesce("b_i", F.lit(0.0))
    df = df.withColumn("predicted_score", model.clip(raw)).drop("b_u", "b_i")
    return df.join(details, "product_id", "left")
