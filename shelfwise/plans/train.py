"""Train each model from cleaned events or the catalog, and write it as a named table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baskets, coldstart, evaluate, features, weights
from ..operators.baselines import Baselines, fit_baselines
from ..operators.factors import Factors, best_factors, fit_factors
from ..operators.names import GROUP
from ..schemas import CATALOG, require_columns, require_rows
from ..sources.artifacts import (
    VERSION_PATTERN,
    announce,
    announced,
    latest_artifact,
    new_name,
    read_model,
)
from ..sources.keyed import BUCKET_ROWS, write_keyed
from ..storage import cut
from . import cart, personal
from .content import K, content_neighbors
from .session import session_candidates

# Name prefixes of the models.
CONTENT = "content_base"
COLLABORATIVE = "collaborative"
COLDSTART = "coldstart"
RULES = "association_rules"

#: Name prefix of the tables that requests are answered from.
SERVING = "serving"


def _write(df: DataFrame, root: str, name: str, part: str = "") -> None:
    df.write.mode("errorifexists").parquet("/".join(x for x in (root.rstrip("/"), name, part) if x))


def train_content(catalog: DataFrame, root: str, k: int = K, at: str | None = None, **limits) -> str:
    require_columns(catalog, CATALOG.fieldNames())
    name = new_name(catalog.sparkSession, CONTENT, at)
    first = catalog.groupBy("product_id").agg(
        F.min(F.struct([c for c in CATALOG.fieldNames() if c != "product_id"])).alias("r")
    )
    _write(content_neighbors(cut(first.select("product_id", "r.*")), k, **limits), root, name)
    return name


def train_collaborative(
    events: DataFrame,
    root: str,
    trials: list[dict[str, float]] | None = None,
    at: str | None = None,
    factors: bool = True,
    grid: list[dict] | None = None,
) -> str:
    """Search the share weights by F1, then fit offsets and factors on all ratings with the best.

    Tables: scale (one row), users, items, factors of users and items, and the trials. With a
    ``grid`` of factorization settings the best by cross-validation is used.
    """
    spark = events.sparkSession
    name = new_name(spark, COLLABORATIVE, at)
    events = cut(events)
    sums = cut(features.share_sums(features.session_features(events)))
    truth, held = evaluate.purchases(events), evaluate.holdout_users(events)
    sweep = cut(weights.weight_sweep(sums, truth, held, trials))
    best = weights.best_weights(sweep)
    score = sum((F.lit(w) * F.col(f"s{i}") for i, w in enumerate(best, 1)), F.lit(0.0))
    ratings = cut(sums.select("user_id", "product_id", score.alias("score")))
    model = fit_baselines(ratings)
    scale = spark.createDataFrame(
        [(model.mean["score"], model.low["score"], model.high["score"])],
        "mean double, low double, high double",
    )
    _write(scale, root, name, "scale")
    _write(model.users, root, name, "users")
    _write(model.items, root, name, "items")
    _write(sweep, root, name, "trials")
    if factors:
        fitted = fit_factors(ratings, model) if grid is None else best_factors(ratings, grid)[1]
    else:
        none = F.lit(None).cast("array<float>")
        fitted = Factors(
            model,
            model.users.limit(0).select("user_id", none.alias("p")),
            model.items.limit(0).select("product_id", none.alias("q")),
        )
    _write(fitted.users, root, name, "user_factors")
    _write(fitted.items, root, name, "item_factors")
    return name


def read_collaborative(spark: SparkSession, root: str, name: str) -> Baselines:
    def part(p: str) -> DataFrame:
        return read_model(spark, root, f"{name}/{p}")

    row = part("scale").first()
    return Baselines(
        ["score"], {"score": row["mean"]}, {"score": row["low"]}, {"score": row["high"]},
        part("users"), part("items"),
    )


def read_factors(spark: SparkSession, root: str, name: str) -> Factors:
    """Offsets and factors of a collaborative model."""
    return Factors(
        read_collaborative(spark, root, name),
        read_model(spark, root, f"{name}/user_factors"),
        read_model(spark, root, f"{name}/item_factors"),
    )


def train_coldstart(
    events: DataFrame,
    root: str,
    top_n: int = coldstart.TOP_N,
    random_n: int = coldstart.RANDOM_N,
    save: bool = True,
    at: str | None = None,
) -> str | None:
    require_columns(events, ["user_session", "product_id"])
    require_rows(events)
    clusters = coldstart.coldstart_clusters(events, top_n, random_n)
    if not save:
        return None
    name = new_name(events.sparkSession, COLDSTART, at)
    _write(clusters, root, name)
    return name


def train_rules(events: DataFrame, root: str, prefix: str = "electronics", at: str | None = None) -> str:
    """Rules on the products whose cleaned category starts with ``prefix``."""
    name = new_name(events.sparkSession, RULES, at)
    prepared = baskets.prepare_baskets(features.prefix_filter(events, prefix))
    _write(baskets.basket_rules(baskets.mine(prepared)), root, name)
    return name


def train_serving(
    events: DataFrame, root: str, names: dict[str, str], at: str | None = None, bucket_rows: int = BUCKET_ROWS
) -> str:
    """Everything that answers to requests read, keyed by what a request looks up.

    Candidates of every product, each known user's best products, product details by product and
    by category and brand, the clusters and who lists a product in them, neighbours, and rules by
    the item under which a cart finds them. What is derived from events is worked out here, once
    for all requests that the models will answer.
    """
    spark = events.sparkSession
    name = new_name(spark, SERVING, at)
    events = cut(events)
    details = cut(features.product_details(events))
    clusters = read_model(spark, root, names[COLDSTART])
    listed = clusters.where(F.col("candidate").isNotNull()).groupBy(F.col("candidate").alias("product_id"))
    rules = cut(read_model(spark, root, names[RULES]))
    factors = read_factors(spark, root, names[COLLABORATIVE])
    users, items = cut(personal.user_rows(factors)), cut(personal.item_rows(factors, details.select("product_id")))
    tables = {
        "details": (details, ["product_id"]),
        "names": (details, GROUP),
        "clusters": (clusters, ["target"]),
        "listed": (listed.agg(F.min("target").alias("cluster")), ["product_id"]),
        "near": (read_model(spark, root, names[CONTENT]), ["product_id"]),
        "candidates": (session_candidates(events, details.select("product_id")), ["target"]),
        "users": (users, ["user_id"]),
        "items": (items, ["product_id"]),
        "best": (personal.best_products(users.select("user_id", "p"), items, personal.fill_size()), ["user_id"]),
        "rules": (cart.rules_by_handle(rules), ["handle"]),
    }
    for part, (df, keys) in tables.items():
        write_keyed(cut(df), f"{root.rstrip('/')}/{name}/{part}", keys, bucket_rows)
    _write(cart.fill_pool(rules), root, name, "pool")
    return name


def train_all(raw_events: DataFrame, catalog: DataFrame, root: str, at: str | None = None, **limits) -> dict[str, str]:
    """All four models and the tables that serve them, then their announcement. Returns the names by prefix."""
    events = cut(features.clean_events(raw_events))
    made = {
        CONTENT: train_content(catalog, root, at=at, **limits),
        COLLABORATIVE: train_collaborative(events, root, at=at),
        COLDSTART: train_coldstart(events, root, at=at),
        RULES: train_rules(events, root, at=at),
    }
    made[SERVING] = train_serving(events, root, made, at)
    announce(events.sparkSession, root, made)
    return made


def current_models(spark: SparkSession, root: str) -> dict[str, str]:
    """Newest announced name of each model."""
    wanted = spark.createDataFrame(
        [(p, p) for p in (CONTENT, COLLABORATIVE, COLDSTART, RULES, SERVING)], "prefix string, default_name string"
    )
    return {r["prefix"]: r["name"] for r in latest_artifact(announced(spark, root), wanted, VERSION_PATTERN).collect()}
