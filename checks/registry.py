"""Every registered query: a callable (session, table folder) -> DataFrame."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.expressions import micros, rounded
from shelfwise.operators import baselines as base
from shelfwise.operators import baskets as bk
from shelfwise.operators import coldstart as cold
from shelfwise.operators import evaluate as ev
from shelfwise.operators import factors as fac
from shelfwise.operators import features as ft
from shelfwise.operators import names, sampling, text
from shelfwise.operators import predictors as pred
from shelfwise.operators import vectors as vec
from shelfwise.operators import weights as wt
from shelfwise.plans import cart, content, incremental, personal, session
from shelfwise.plans import cold as coldplan
from shelfwise.session import prepare
from shelfwise.sources import artifacts
from shelfwise.storage import checkpoint_dir, cut
from shelfwise.streaming import retrain

from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(prepare(spark), sf)

    QUERIES[fn.__name__] = run
    return run


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return ft.clean_events(fx.behaviors(spark, sf))


def features(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    # Several branches read the events: they are parsed once.
    return ft.session_features(cut(clean(spark, sf)) if events is None else events)


def scores(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    return ft.user_product_scores(features(spark, sf, events))


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n)) for n in names})


@query
def clean_events(spark, sf):
    return clean(spark, sf).withColumn("event_us", micros(F.col("event_time"))).drop("event_time")


@query
def encoded_features(spark, sf):
    df = ft.feature_pipeline(fx.behaviors(spark, sf)).select(
        "event_id", *ft.ENCODED, "event_type", "total_view", "is_view", "duration", "F1", "F2", "F3", "F4"
    )
    return six(df, "duration", "F1", "F2", "F3", "F4")


@query
def session_features(spark, sf):
    df = features(spark, sf).select(
        "event_id", "user_id", "user_session", "product_id", "event_type",
        *[f"{k}_{t}" for k in ("total", "is") for t in ft.EVENT_TYPES],
        "duration", "total_duration", "F1", "F2", "F3", "F4",
    )
    return six(df, "duration", "total_duration", "F1", "F2", "F3", "F4")


@query
def user_product_scores(spark, sf):
    return six(scores(spark, sf), "score")


@query
def trending(spark, sf):
    return six(ft.trending(scores(spark, sf), fx.catalog(spark, sf)), "trending_score")


@query
def profile(spark, sf):
    events = clean(spark, sf)
    return ft.profile(
        {
            "raw": fx.behaviors(spark, sf),
            "clean": events,
            "first_touch": ft.first_touches(events),
        }
    )


@query
def prefix_filter(spark, sf):
    return ft.prefix_filter(clean(spark, sf)).select("event_id", "product_id", "category_code")


@query
def product_details(spark, sf):
    return ft.product_details(clean(spark, sf))


@query
def recent_sessions(spark, sf):
    df = ft.recent_sessions(clean(spark, sf))
    return df.select("product_id", "user_session", F.col("cutoff").cast("string").alias("cutoff"))


# ---- sampling, numbering, sessions ---------------------------------------------------------
@query
def sample_fraction(spark, sf):
    sessions = clean(spark, sf).select("user_session").distinct()
    return sampling.sample_fraction(sessions, ["user_session"], 0.3, 42)


@query
def label_encode(spark, sf):
    events = clean(spark, sf).select("event_id", "product_id", "user_id", "user_session")
    coded = sampling.label_encode(events, ["product_id", "user_id", "user_session"])
    return coded.select(
        "event_id", *[F.col(c).cast("bigint") for c in ("product_id", "user_id", "user_session")]
    )


@query
def cooccurrence(spark, sf):
    return cold.cooccurrence(clean(spark, sf))


def clusters(spark, sf, top_n=cold.TOP_N, random_n=cold.RANDOM_N):
    return cold.coldstart_clusters(clean(spark, sf), top_n, random_n)


@query
def coldstart_clusters(spark, sf):
    return clusters(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))


@query
def incremental_clusters(spark, sf):
    """All events in three batches that tear sessions apart, one of them twice, put together once."""
    events = clean(spark, sf)
    root = f"{checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    batch = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for number in (2, 0, 2, 1):
        incremental.update_clusters(events.where(batch == number), root, str(number))
        if number == 0:
            incremental.compact(spark, root)
    return incremental.current_clusters(spark, root).withColumn("rank", F.col("rank").cast("bigint"))


@query
def cluster_for_target(spark, sf):
    return cold.cluster_for_target(clusters(spark, sf), fx.catalog(spark, sf))


@query
def latest_artifact(spark, sf):
    kinds = ("view", "cart", "purchase", "error_model")
    events = fx.behaviors(spark, sf)
    stamped = events.where(F.col("event_type").isin("view", "cart")).select(
        F.concat(
            "event_type", F.lit("_"), F.date_format("event_time", "dd_MM_yy_HH_mm"), F.lit(".pkl")
        ).alias("name")
    )
    untimed = events.where(F.col("event_type").isin("view", "purchase")).select(
        F.concat("event_type", F.lit("_99_99_99_"), "user_id", F.lit(".pkl")).alias("name")
    )
    wanted = spark.createDataFrame(
        [(k, f"{k}_default") for k in kinds], "prefix string, default_name string"
    )
    return artifacts.latest_artifact(stamped.union(untimed).distinct(), wanted)


# ---- baskets, itemsets, rules, carts -------------------------------------------------------
@query
def baskets(spark, sf):
    sizes = bk.basket_sizes(bk.line_counts(clean(spark, sf)))
    return sampling.sample_fraction(sizes, ["basket"], bk.SAMPLE_RATIO, bk.SAMPLE_SEED)


@query
def frequent_items(spark, sf):
    lines = bk.line_counts(fx.brand_lines(spark, sf))
    ids = sampling.sample_fraction(
        bk.basket_sizes(lines).select("basket"), ["basket"], bk.SAMPLE_RATIO, bk.SAMPLE_SEED
    )
    return bk.frequent_items(lines.join(ids, "basket", "left_semi"))


@query
def basket_items(spark, sf):
    return bk.prepare_baskets(fx.brand_lines(spark, sf)).items.select("basket", "item")


def brand_model(spark, sf):
    return bk.mine(bk.prepare_baskets(fx.brand_lines(spark, sf)))


@query
def frequent_itemsets(spark, sf):
    sets = bk.frequent_itemsets(brand_model(spark, sf))
    return sets.select(
        F.array_join("items", ",").alias("items"), F.size("items").cast("bigint").alias("size"), "freq"
    )


@query
def basket_rules(spark, sf):
    rules = bk.basket_rules(brand_model(spark, sf))
    rules = rules.withColumn("antecedent", F.array_join("antecedent", ","))
    return six(rules, "support", "confidence", "lift", "score")


@query
def basket_rules_all(spark, sf):
    prepared = bk.prepare_baskets(fx.brand_lines(spark, sf))
    rules = bk.all_rules(bk.frequent_itemsets(bk.mine(prepared)), prepared.ids.count())
    rules = rules.withColumns({c: F.array_join(c, ",") for c in ("antecedent", "consequent")})
    return six(rules, "support", "confidence", "lift", "leverage")


def brand_carts(spark, sf):
    return fx.brand_lines(spark, sf).groupBy(F.col("user_session").alias("cart")).agg(
        F.collect_set("product_id").alias("cart_items")
    )


@query
def cart_matches(spark, sf):
    # Equal carts have equal matches, which are found and added up once.
    carts, unique = cart.equal_carts(brand_carts(spark, sf))
    found = cart.cart_matches(cut(bk.basket_rules(brand_model(spark, sf))), unique)
    summary = found.groupBy("cart").agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.count_distinct("consequent").alias("n_products"),
        F.max("score").alias("best_score"),
        F.sum("score").alias("total_score"),
    )
    summary = carts.select("cart", "key").join(summary.withColumnRenamed("cart", "key"), "key").drop("key")
    return six(summary, "best_score", "total_score")


@query
def cart_recommend(spark, sf):
    rules = cut(bk.basket_rules(brand_model(spark, sf)))
    return cart.cart_recommend(rules, brand_carts(spark, sf)).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


# ---- offsets, splits, evaluation -----------------------------------------------------------
@query
def rating_scale(spark, sf):
    return six(base.rating_scale(scores(spark, sf)), "min_score", "max_score")


def all_predicted(spark, sf):
    ratings = cut(scores(spark, sf))
    return base.predict_baselines(base.fit_baselines(ratings), ratings)


@query
def bias_scores(spark, sf):
    df = all_predicted(spark, sf).select("user_id", "product_id", "b_u", "b_i", "est")
    return six(df, "b_u", "b_i", "est")


@query
def rating_errors(spark, sf):
    return six(base.rating_errors(all_predicted(spark, sf)), "rmse", "mae")


@query
def model_users(spark, sf):
    return base.model_users(base.fit_baselines(scores(spark, sf)))


@query
def eligible_users(spark, sf):
    return ev.eligible_users(clean(spark, sf))


def holdout(spark, sf, events=None):
    events = cut(clean(spark, sf)) if events is None else events
    return ev.split_by_user(cut(scores(spark, sf, events)), cut(ev.holdout_users(events)))


@query
def holdout_test(spark, sf):
    return six(holdout(spark, sf)[0], "score")


@query
def holdout_train(spark, sf):
    return six(holdout(spark, sf)[1], "score")


def holdout_lists(spark, sf, events=None):
    test, train = holdout(spark, sf, events)
    return ev.top_n(base.predict_baselines(base.fit_baselines(train), test))


@query
def eval_topn(spark, sf):
    df = holdout_lists(spark, sf).select(
        "user_id", "product_id", F.col("rank").cast("bigint").alias("rank"), F.col("raw").alias("est")
    )
    return six(df, "est")


@query
def eval_f1(spark, sf):
    events = cut(clean(spark, sf))
    found = ev.micro_f1(holdout_lists(spark, sf, events), ev.purchases(events))
    return six(found, "precision", "recall", "f1")


@query
def eval_user_precision(spark, sf):
    truth = ev.purchases(clean(spark, sf))
    half = ev.sample_purchases(truth)
    model = base.fit_baselines(scores(spark, sf))
    return six(ev.user_precision(ev.top_n(base.predict_baselines(model, half)), truth), "precision")


@query
def scalar_ratio_weights(spark, sf):
    # Ratios read off the part table, one set per product; the largest sizes break the order.
    part = fx.table(spark, sf, "part")
    ratios = part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        (0.6 + 0.3 * F.col("p_size") / 50).alias("w3"),
        (0.2 + 0.8 * F.col("p_size") / 50).alias("r2"),
        (0.1 + 0.9 * F.length("p_name") / 20).alias("r4"),
        (0.1 + 0.9 * F.length("p_type") / 8).alias("r1"),
    )
    df = wt.ratio_weights(ratios).select("product_id", "w1", "w2", "w3", "w4", "valid")
    return six(df, "w1", "w2", "w3", "w4")


@query
def weight_sweep(spark, sf):
    events = cut(clean(spark, sf))
    sums = cut(ft.share_sums(ft.session_features(events)))
    swept = wt.weight_sweep(sums, ev.purchases(events), ev.holdout_users(events))
    return six(
        swept.select("weight_id", "w1", "w2", "w3", "w4", "hits", "recommended", "actual", "f1"),
        "w1", "w2", "w3", "w4", "f1",
    )


# ---- text, neighbours, vectors -------------------------------------------------------------
@query
def concat_features(spark, sf):
    return text.concat_features(fx.catalog(spark, sf))


@query
def tfidf_weights(spark, sf):
    df = text.tfidf_weights(text.concat_features(fx.catalog(spark, sf)))
    return six(df.select("product_id", "term", "tf", "weight"), "weight")


@query
def tfidf_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text"
    )
    df = text.tfidf_weights(docs, "doc_id")
    return six(df.select("doc_id", "term", "tf", "weight"), "weight")


def big_rank(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@query
def content_neighbors(spark, sf):
    return big_rank(content.content_neighbors(fx.catalog(spark, sf)))


@query
def content_recommend(spark, sf):
    model = cut(content.content_neighbors(fx.catalog(spark, sf)))
    asked = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("product_id"))
    return big_rank(content.content_recommend(model, asked))


@query
def same_category_brand(spark, sf):
    return big_rank(names.same_category_brand(fx.details(spark, sf)))


@query
def name_similarity(spark, sf):
    return big_rank(names.name_similarity(fx.details(spark, sf)))


@query
def vector_lookup(spark, sf):
    points = fx.vectors(spark, sf)
    df = vec.vector_lookup(points, points.select("label"), "label")
    return six(
        df.select(
            "label", "point_id", F.size("embedding").cast("bigint").alias("dims"),
            F.element_at("embedding", 1).cast("double").alias("head"),
            F.element_at("embedding", -1).cast("double").alias("tail"),
        ),
        "head", "tail",
    )


@query
def vector_truncate(spark, sf):
    df = vec.vector_truncate(fx.vectors(spark, sf), 32)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return six(
        df.select("point_id", F.size("embedding").cast("bigint").alias("dims"), total.alias("total")),
        "total",
    )


@query
def vector_topk(spark, sf):
    return big_rank(vec.vector_topk(fx.vectors(spark, sf)))


@query
def vector_search(spark, sf):
    df = big_rank(vec.search_points(fx.vectors(spark, sf)))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return six(df.select("id", "rank", "point_id", "similarity", "label", total.alias("total")), "similarity", "total")


@query
def hashed_vectors(spark, sf):
    df = vec.hashed_vectors(fx.catalog(spark, sf))
    df = df.select("point_id", "name", "price", F.posexplode("embedding").alias("bucket", "weight"))
    df = df.where(F.col("weight") != 0).withColumn("weight", F.col("weight").cast("double"))
    return six(df.withColumn("bucket", F.col("bucket").cast("bigint")), "weight")


def product_points(spark, sf):
    """One point per event, under the id of its session: ids repeat."""
    return clean(spark, sf).select(
        F.col("user_session").alias("point_id"), "event_time", "event_id", "event_type", "product_id", "price"
    )


@query
def dedupe_points(spark, sf):
    points = product_points(spark, sf)
    bought = points.where(F.col("event_type") == "purchase")
    others = points.where(F.col("event_type") != "purchase").drop("price")
    df = vec.dedupe_points([bought, others], ["event_time", "event_id"])
    return df.select("point_id", "event_id", "event_type", "product_id", "price")


@query
def upsert_latest(spark, sf):
    points = product_points(spark, sf).withColumnRenamed("event_id", "version")
    points = points.select("product_id", "version", "event_type", F.col("price").cast("string").alias("price"))
    stored = points.where(F.col("event_type") == "view")
    arriving = points.where(F.col("event_type") != "view")
    arriving = arriving.withColumn("price", F.expr("CASE WHEN event_type <> 'error' THEN price END"))
    return vec.upsert_latest(stored, arriving)


# ---- recommendations -----------------------------------------------------------------------
@query
def session_candidates(spark, sf):
    events = cut(clean(spark, sf))
    return session.session_candidates(events, fx.last_touch(spark, sf))


@query
def session_recommend(spark, sf):
    events = cut(clean(spark, sf))
    model = base.fit_baselines(ft.user_product_scores(ft.session_features(events)))
    df = session.session_recommend(
        fx.last_touch(spark, sf), events, model, ft.product_details(events)
    )
    return six(big_rank(df), "predicted_score")


def fixed_factors(df, key, name, letter):
    """Factors in steps of 1/64 from the md5 of the ids, the same in both engines."""
    part = [
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{letter}{j}:"), key)), 1, 6), 16, 10).cast("bigint") % 17 - 8) / 64.0
        for j in range(4)
    ]
    return df.select(key, F.array(*part).alias(name))


@query
def personal_recommend(spark, sf):
    events = cut(clean(spark, sf))
    model = base.fit_baselines(ft.user_product_scores(ft.session_features(events)))
    factors = fac.Factors(
        model,
        fixed_factors(model.users, "user_id", "p", "u"),
        fixed_factors(model.items, "product_id", "q", "i"),
    )
    df = personal.personal_recommend(
        fx.last_touch(spark, sf), events, factors, ft.product_details(events), item_block=256
    )
    return six(big_rank(df), "predicted_score")


@query
def coldstart_recommend(spark, sf):
    df = coldplan.cold_recommend(
        fx.catalog(spark, sf), clusters(spark, sf), fx.details(spark, sf)
    )
    return big_rank(df)


@query
def anonymous_recommend(spark, sf):
    small = cut(clusters(spark, sf, top_n=5, random_n=2))
    df = coldplan.anonymous_recommend(fx.catalog(spark, sf), small, fx.details(spark, sf))
    return big_rank(df)


# ---- rating predictors ---------------------------------------------------------------------
def rating_split(spark, sf):
    return pred.split_ratings(scores(spark, sf))


def _predictor(name, make):
    def run(spark, sf):
        train, test = rating_split(spark, sf)
        return six(make(train, test).select("user_id", "product_id", "score", "est"), "score", "est")

    run.__name__ = name
    return query(run)


_predictor("knn_basic", pred.knn_basic)
_predictor("knn_means", pred.knn_means)
_predictor("knn_baseline", pred.knn_baseline)
_predictor("slope_one", pred.slope_one)
_predictor("normal_predictor", pred.normal_predictor)
_predictor("coclustering", pred.coclustering)
_predictor("nmf_scores", fac.nmf_scores)
_predictor("mf_scores", lambda train, test: fac.predict_factors(fac.fit_factors(train), test))


@query
def mf_grid_search(spark, sf):
    grid = [{"rank": 4, "regParam": 0.1}, {"rank": 8, "regParam": 0.1}]
    return fac.grid_search(scores(spark, sf), grid)


@query
def model_compare_fixed(spark, sf):
    """The compared models whose predictions do not depend on an iterative fit's details."""
    train, test = rating_split(spark, sf)
    offsets = base.fit_baselines(train)
    near = cut(pred.neighbor_sums(pred.rating_neighbors(train, test, carry=offsets.users)))
    models = {
        "knnbasic": pred.knn_basic(train, test, near),
        "knnwithmeans": pred.knn_means(train, test, near),
        "knnbaseline": pred.knn_baseline(train, test, near, offsets),
        "normalpredictor": pred.normal_predictor(train, test),
        "slopeone": pred.slope_one(train, test),
    }
    found = pred.compare(models).select("model", "rmse", "mae")
    return found.withColumns({c: F.round(c, 4) for c in ("rmse", "mae")})


@query
def model_compare(spark, sf):
    return pred.model_compare(*rating_split(spark, sf))


# ---- streams, in their batch form ----------------------------------------------------------
@query
def stream_filter(spark, sf):
    records = fx.retrain_records(spark, sf)
    now = fx.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    kept = retrain.accepted(records, now)
    return kept.select("offset", "message", micros(F.col("event_time")).alias("event_us"))
