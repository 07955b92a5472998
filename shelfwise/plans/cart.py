"""Cart recommendation: rules whose antecedent lies in the cart, then the best consequents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut, spread

# Default number of recommendations and size of the fill pool.
DEFAULT_K = 5
POOL = 200

# Carts that one task matches, and rules that are sent to all tasks.
CART_BLOCK = 50_000
SENT_RULES = 200_000


def _rule_lists(rules: DataFrame) -> DataFrame:
    """Rules with the id of their antecedent and their place among its consequents."""
    nth = F.row_number().over(Window.partitionBy("ant").orderBy(F.desc("score"), "consequent"))
    ids = rules.withColumn("ant", F.sha2(F.array_join("antecedent", "\u0001"), 256))
    return ids.select("ant", "antecedent", "consequent", "score", nth.alias("nth"))


def antecedent_sets(lists: DataFrame) -> DataFrame:
    """antecedent, item, rules: every antecedent once, with the one of its items that fewest
    antecedents use and with its consequents, of which there are at most as many as items."""
    own = F.collect_list(F.struct("consequent", "score", "nth")).alias("rules")
    sets = cut(lists.groupBy("ant").agg(F.any_value("antecedent").alias("antecedent"), own))
    exploded = sets.select("ant", F.explode("antecedent").alias("item"))
    usage = exploded.groupBy("item").agg(F.count(F.lit(1)).alias("uses"))
    rarest = F.min_by("item", F.struct("uses", "item")).alias("item")
    return sets.join(exploded.join(usage, "item").groupBy("ant").agg(rarest), "ant").drop("ant")


def cart_matches(rules: DataFrame, carts: DataFrame, enough: Column | None = None) -> DataFrame:
    """cart, antecedent, consequent, score: antecedent inside the cart, consequent outside.

    Works on distinct antecedents, not on rules. Each is looked up by one of its items only; the
    rest of the subset test runs on the two arrays, and its consequents come along, so there are
    no (cart, rule, item) rows to shuffle and count. The carts are dealt out by their name, in
    parts of bounded size; as long as the rules are few enough to be sent everywhere, all matches
    of a cart come up where the cart is, and what is grouped by cart needs no further shuffle.

    With ``enough``, the number of recommendations asked for, an antecedent only brings its first
    enough + size(cart) consequents: at most size(cart) of them are in the cart, and what follows
    is beaten by the others.
    """
    carts = cut(carts.select("cart", "cart_items"))
    items = spread(carts, "cart", least=-(-carts.count() // CART_BLOCK))
    items = items.select("cart", "cart_items", F.explode("cart_items").alias("item"))
    sets = cut(antecedent_sets(_rule_lists(rules)))
    if (sets.agg(F.sum(F.size("rules"))).first()[0] or 0) <= SENT_RULES:
        sets = F.broadcast(sets)
    inside = (F.size("antecedent") == 1) | F.forall(
        "antecedent", lambda x: F.array_contains(F.col("cart_items"), x)
    )
    found = items.join(sets, "item").where(inside)
    found = found.select("cart", "cart_items", "antecedent", F.inline("rules"))
    found = found.where(~F.array_contains("cart_items", F.col("consequent")))
    if enough is not None:
        found = found.where(F.col("nth") <= enough + F.size("cart_items"))
    return found.select("cart", "antecedent", "consequent", "score")


def equal_carts(carts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(carts, unique): ``carts`` with ``key``, its items without order and repeats, and a table of
    carts named by it, which can be matched in place of the carts that share their items."""
    keyed = cut(carts.withColumn("key", F.array_sort(F.array_distinct("cart_items"))))
    return keyed, keyed.select(F.col("key").alias("cart"), F.col("key").alias("cart_items")).distinct()


def fill_pool(rules: DataFrame, size: int = POOL) -> DataFrame:
    """The first ``size`` distinct consequents by score: rank, consequent."""
    best = rules.groupBy("consequent").agg(F.max("score").alias("score"))
    pool = best.orderBy(F.desc("score"), "consequent").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "consequent"))
    return pool.select("consequent", rank.alias("rank"))


def rules_by_handle(rules: DataFrame) -> DataFrame:
    """``rules`` with ``handle``, the item of the antecedent that fewest antecedents use: a cart that
    holds the antecedent holds its handle."""
    sets = rules.select(F.explode("antecedent").alias("item"), "antecedent").distinct()
    usage = sets.groupBy("item").agg(F.count(F.lit(1)).alias("uses"))
    rarest = F.min_by("item", F.struct("uses", "item")).alias("handle")
    return rules.join(sets.join(usage, "item").groupBy("antecedent").agg(rarest), "antecedent")


def cart_recommend(
    rules: DataFrame, carts: DataFrame, k: int = DEFAULT_K, pool: DataFrame | None = None
) -> DataFrame:
    """cart, rank, product_id. ``carts`` has cart, cart_items and optionally its own ``k``.

    Equal carts are answered once. The fill pool has a fixed largest size; with a ``pool`` from all
    rules, ``rules`` need only hold those whose handle lies in one of the carts.
    """
    wanted = F.col("k") if "k" in carts.columns else F.lit(k)
    requests = carts.select(
        "cart",
        F.array_sort(F.array_distinct("cart_items")).alias("cart_items"),
        wanted.cast("int").alias("k"),
    ).where(F.size("cart_items") > 0)
    requests = cut(requests.withColumn("key", F.sha2(F.array_join("cart_items", "\u0001"), 256)))
    unique = requests.groupBy(F.col("key").alias("cart")).agg(
        F.any_value("cart_items").alias("cart_items"), F.max("k").alias("k")
    )
    largest = requests.agg(F.max("k")).scalar()
    matched = cart_matches(rules, unique, largest).groupBy("cart", "consequent").agg(
        F.max("score").alias("score")
    )
    rank = F.row_number().over(
        Window.partitionBy("cart").orderBy(F.desc("score"), "consequent")
    )
    best = (
        matched.withColumn("rank", rank)
        .join(unique.select("cart", "k"), "cart")
        .where(F.col("rank") <= F.col("k"))
        .groupBy("cart")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "consequent"))).alias("hits"))
    )
    pool = (fill_pool(rules) if pool is None else pool).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "consequent"))),
            lambda x: x["consequent"],
        )
    )
    hits = F.coalesce(
        F.transform("hits", lambda x: x["consequent"]), F.array().cast("array<string>")
    )
    full = unique.join(best, "cart", "left").withColumn("recs", hits)
    full = full.withColumn("pool", pool.scalar()).withColumn(
        "recs", F.concat("recs", F.array_except(F.array_except("pool", "cart_items"), "recs"))
    )
    lists = full.select(F.col("cart").alias("key"), "recs")
    return (
        requests.select("cart", "key", "k")
        .join(lists, "key")
        .select("cart", F.posexplode(F.slice("recs", F.lit(1), F.col("k"))).alias("pos", "product_id"))
        .select("cart", (F.col("pos") + 1).alias("rank"), "product_id")
    )
