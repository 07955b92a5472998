"""From raw events to session features, user-product scores and trending products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expressions import first_of, is_present, micros, safe_ratio
from ..schemas import require_columns
from ..storage import cut
from .hot import none_hot, split_hot
from .sampling import label_encode

# Event types that carry a share, and the default weights of the four shares.
EVENT_TYPES = ("view", "cart", "purchase")
DEFAULT_WEIGHTS = (0.1, 0.3, 0.4, 0.2)

SESSION = ["user_id", "user_session"]
ITEM = ["user_id", "user_session", "product_id"]

# Rows of one session that a single task may sort.
SESSION_ROWS = 1_000_000


def clean_events(events: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Drop ``eventTime``, delete rows with a missing or zero value, normalise ids and category.

    Columns in ``keep`` only break ties later and are not subject to the zero rule.
    """
    require_columns(events, ["eventTime", "category_code", *ITEM])
    df = events.drop("eventTime")
    for field in df.schema.fields:
        if field.name not in keep:
            df = df.where(is_present(field.name, field.dataType))
    return df.withColumns(
        {
            "category_code": F.translate("category_code", ".", " "),
            "product_id": F.col("product_id").cast("string"),
            "user_id": F.col("user_id").cast("string"),
            "user_session": F.col("user_session").cast("string"),
        }
    )


def _tie(df: DataFrame) -> list[str]:
    return ["event_id"] if "event_id" in df.columns else ["event_type", "product_id"]


def _of_type(kind: str) -> Column:
    return F.when(F.col("event_type") == kind, 1)


def _unique_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct; the smallest ``event_id`` of the copies is kept for ordering."""
    if "event_id" not in df.columns:
        return df.distinct()
    keys = [c for c in df.columns if c != "event_id"]
    return df.groupBy(*keys).agg(F.min("event_id").alias("event_id"))


def _ordinary_sessions(df: DataFrame) -> DataFrame:
    """All windows share the hash partitioning of one exchange, and the first two one sort."""
    session = Window.partitionBy(*SESSION)
    item = Window.partitionBy(*ITEM)
    df = df.repartition(*SESSION)
    df = df.withColumns({f"is_{t}": F.count(_of_type(t)).over(item) for t in EVENT_TYPES})
    df = df.withColumns({f"total_{t}": F.count(_of_type(t)).over(session) for t in EVENT_TYPES})
    df = _unique_rows(df).withColumn("__us", micros(F.col("event_time")))
    ordered = session.orderBy("__us", *_tie(df))
    df = df.withColumn("__gap", F.col("__us") - F.coalesce(F.lag("__us").over(ordered), "__us"))
    return df.withColumn("__span", F.sum("__gap").over(session))


def _hot_sessions(df: DataFrame, rows: int) -> DataFrame:
    """The same columns for sessions too large for one task.

    Counts are combined on the map side and joined back. A session is cut into time slices, each
    slice is ordered on its own, and the first row of a slice takes its predecessor from the
    slices' end times. The span is last minus first time, since the gaps telescope.
    """
    df = df.withColumn("__us", micros(F.col("event_time")))
    per_session = df.groupBy(*SESSION).agg(
        *[F.count(_of_type(t)).alias(f"total_{t}") for t in EVENT_TYPES],
        F.min("__us").alias("__lo"),
        F.max("__us").alias("__hi"),
        F.ceil(F.count(F.lit(1)) / rows).alias("__slices"),
    )
    per_item = df.groupBy(*ITEM).agg(
        *[F.count(_of_type(t)).alias(f"is_{t}") for t in EVENT_TYPES]
    )
    df = _unique_rows(df).join(per_session, SESSION)
    df = df.withColumn("__span", F.col("__hi") - F.col("__lo")).withColumn(
        "__slice",
        F.floor(
            safe_ratio((F.col("__us") - F.col("__lo")) * F.col("__slices"), F.col("__span") + 1)
        ),
    )
    part = [*SESSION, "__slice"]
    ends = df.groupBy(*part).agg(F.max("__us").alias("__end"))
    before = ends.select(
        *part, F.lag("__end").over(Window.partitionBy(*SESSION).orderBy("__slice")).alias("__prev")
    )
    ordered = Window.partitionBy(*part).orderBy("__us", *_tie(df))
    df = df.withColumn("__lag", F.lag("__us").over(ordered)).join(before, part)
    df = df.withColumn("__gap", F.col("__us") - F.coalesce("__lag", "__prev", "__us"))
    return df.join(per_item, ITEM).drop("__lo", "__hi", "__slices", "__slice", "__prev", "__lag")


def session_features(clean: DataFrame, session_rows: int = SESSION_ROWS) -> DataFrame:
    """Event rows with counts per item and session, dwell time and the shares F1 to F4.

    Counts see repeated rows, durations do not. Every event type takes part in the durations. Where
    no session can be hot, the events are shuffled once and the path of hot sessions is not planned.
    """
    if none_hot(clean, SESSION, session_rows):
        df = _ordinary_sessions(clean)
    else:
        ordinary, hot = split_hot(clean, SESSION, session_rows)
        df = _ordinary_sessions(ordinary).unionByName(_hot_sessions(hot, session_rows))
    df = df.withColumns(
        {"duration": F.col("__gap") / 1e6, "total_duration": F.col("__span") / 1e6}
    ).drop("__us", "__gap", "__span")
    return df.withColumns(
        {
            "F1": safe_ratio(F.col("is_view"), F.col("total_view")),
            "F2": safe_ratio(F.col("is_cart"), F.col("total_cart")),
            "F3": safe_ratio(F.col("is_purchase"), F.col("total_purchase")),
            "F4": safe_ratio(F.col("duration"), F.col("total_duration")),
        }
    )


# The columns that the encoded form of the features numbers.
ENCODED = ["product_id", "user_id", "user_session"]


def feature_pipeline(raw: DataFrame, encoded: bool = True) -> DataFrame:
    """Raw events to session features; ids are replaced by their numbers in sorted order unless
    ``encoded`` is off. Numbers keep equal ids equal, so the features are the same. Events and features
    are written, since several branches read them."""
    features = session_features(cut(clean_events(raw)))
    return label_encode(cut(features), ENCODED) if encoded else features


def share_sums(features: DataFrame) -> DataFrame:
    """Sums of F1..F4 over event rows, per user and product. Any weighting is linear in them."""
    return features.groupBy("user_id", "product_id").agg(
        *[F.sum(f"F{i}").alias(f"s{i}") for i in range(1, 5)]
    )


def user_product_scores(
    features: DataFrame, weights: tuple[float, float, float, float] = DEFAULT_WEIGHTS
) -> DataFrame:
    """Weighted score per user and product, added up over event rows."""
    total = sum((F.lit(w) * F.col(f"s{i}") for i, w in enumerate(weights, 1)), F.lit(0.0))
    return share_sums(features).select("user_id", "product_id", total.alias("score"))


def trending(scores: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog with each product's summed score; null where nobody touched it."""
    per_product = scores.groupBy("product_id").agg(F.sum("score").alias("trending_score"))
    return catalog.join(per_product, "product_id", "left")


def product_details(
    events: DataFrame, fields: tuple[str, ...] = ("name", "category_code", "brand")
) -> DataFrame:
    """One row per product: that of its earliest event."""
    order = [F.col("event_time"), *[F.col(c) for c in _tie(events)]]
    first = events.groupBy("product_id").agg(first_of(order, list(fields)).alias("d"))
    return first.select("product_id", "d.*")


def prefix_filter(events: DataFrame, prefix: str = "electronics") -> DataFrame:
    return events.where(F.col("category_code").startswith(prefix))


def profile(tables: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """Rows, distinct users and distinct products of each named table."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    out = None
    for stage, df in tables.items():
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            distinct("user_id").alias("n_users"),
            distinct("product_id").alias("n_products"),
        ).select(F.lit(stage).alias("stage"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def first_touches(events: DataFrame) -> DataFrame:
    """Earliest event of each user and product."""
    rest = tuple(c for c in events.columns if c not in ("user_id", "product_id"))
    order = [F.col("event_time"), *[F.col(c) for c in _tie(events)]]
    first = events.groupBy("user_id", "product_id").agg(first_of(order, list(rest)).alias("d"))
    return first.select("user_id", "product_id", "d.*")


def recent_sessions(events: DataFrame, targets: DataFrame | None = None, months: int = 3) -> DataFrame:
    """Sessions that hold a product within ``months`` of that product's last event."""
    if targets is not None:
        events = events.join(targets.select("product_id").distinct(), "product_id", "left_semi")
    last = events.groupBy("product_id", "user_session").agg(F.max("event_time").alias("t"))
    spans = last.groupBy("product_id").agg(F.max("t").alias("last_time"))
    spans = spans.withColumn("cutoff", F.col("last_time") - F.make_ym_interval(F.lit(0), F.lit(months)))
    return (
        last.join(spans, "product_id")
        .where(F.col("t") >= F.col("cutoff"))
        .select("product_id", "user_session", "cutoff", "last_time")
    )
