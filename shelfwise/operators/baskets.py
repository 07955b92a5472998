"""Baskets from sessions, frequent itemsets (FP-Growth) and rules with one or more consequents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..storage import cut
from .sampling import sample_fraction

# Defaults of basket preparation and rule mining.
SAMPLE_RATIO = 0.3
SAMPLE_SEED = 42
MIN_ITEM_COUNT = 5
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.08


@dataclass
class Baskets:
    """``ids``: one row per basket. ``items``: distinct (basket, item, n) of frequent items."""

    ids: DataFrame
    items: DataFrame


def line_counts(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """basket, item, n: repeated items are counted, not listed, so no basket is collected."""
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    return events.groupBy(
        F.col("user_session").alias("basket"), F.col("product_id").alias("item")
    ).agg(F.count(F.lit(1)).alias("n"))


def basket_sizes(lines: DataFrame) -> DataFrame:
    """Baskets of more than one line; a repeated item counts each time."""
    sizes = lines.groupBy("basket").agg(
        F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_items")
    )
    return sizes.where(F.col("n_lines") > 1)


def frequent_items(lines: DataFrame, min_item_count: int = MIN_ITEM_COUNT) -> DataFrame:
    counts = lines.groupBy("item").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_baskets")
    )
    return counts.where(F.col("occurrences") >= min_item_count)


def prepare_baskets(
    events: DataFrame,
    sample_ratio: float = SAMPLE_RATIO,
    event_type: str | None = None,
    min_item_count: int = MIN_ITEM_COUNT,
    seed: int | str = SAMPLE_SEED,
) -> Baskets:
    lines = cut(line_counts(events, event_type))
    ids = basket_sizes(lines).select("basket")
    if 0 < sample_ratio < 1:
        ids = sample_fraction(ids, ["basket"], sample_ratio, seed)
    ids = cut(ids)
    sampled = lines.join(ids, "basket", "left_semi")
    often = frequent_items(sampled, min_item_count).select("item")
    return Baskets(ids, cut(sampled.join(often, "item", "left_semi")))


def mine(
    baskets: Baskets, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> FPGrowthModel:
    """Fit FP-Growth. Baskets left without a frequent item still count in the support.

    Items below the support cannot be part of any frequent set and go first. Supports add up to
    the mean basket size, so at most mean size / min_support items remain: that bounds every
    basket's array, even that of a session which holds a large part of all rows.
    """
    n = baskets.ids.count()
    supported = (
        baskets.items.groupBy("item")
        .agg(F.count(F.lit(1)).alias("c"))
        .where(F.col("c") >= min_support * n)
        .select("item")
    )
    arrays = (
        baskets.items.join(supported, "item", "left_semi")
        .groupBy("basket")
        .agg(F.collect_list("item").alias("items"))
    )
    rows = baskets.ids.join(arrays, "basket", "left").select(
        F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
    return FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(cut(rows))


def frequent_itemsets(model: FPGrowthModel) -> DataFrame:
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")


def basket_rules(model: FPGrowthModel) -> DataFrame:
    """antecedent, consequent, support, confidence, lift, score = confidence * lift.

    The score is rounded so that equal rules rank by id and not by the last bit.
    """
    return model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"),
        F.element_at("consequent", 1).alias("consequent"),
        "support",
        "confidence",
        "lift",
        rounded(F.col("confidence") * F.col("lift")).alias("score"),
    )


def all_rules(itemsets: DataFrame, n_baskets: int, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """antecedent, consequent (both sorted arrays), support, confidence, lift, leverage.

    Every split of every frequent set (``items``, ``freq``) into two parts that are not empty. The
    antecedent shrinks as the consequent grows, and its count can only rise, so a split that
    falls short of the confidence is not grown any further: consequents grow by one item at a
    time, always a later one of the set, so that each is reached once, from its own beginning.
    Rounds are the items of the largest set less one.
    """
    name = lambda c: F.sha2(F.array_join(c, "\u0001"), 256)
    sets = itemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("double").alias("freq"))
    sets = cut(sets.withColumn("key", name(F.col("items"))))
    counts = sets.select("key", F.col("freq").alias("part_freq"))
    empty = F.array().cast("array<string>")
    grown = sets.where(F.size("items") > 1).select("items", "freq", empty.alias("consequent"), F.lit(0).alias("at"))
    found = None
    while True:
        places = F.sequence(F.col("at") + 1, F.size("items"))
        longer = grown.where((F.col("at") < F.size("items")) & (F.size("consequent") < F.size("items") - 1))
        longer = longer.select("items", "freq", "consequent", F.explode(places).alias("at"))
        longer = longer.withColumn("consequent", F.concat("consequent", F.array(F.element_at("items", F.col("at")))))
        longer = longer.withColumn("antecedent", F.array_except("items", "consequent"))
        held = longer.withColumn("key", name(F.col("antecedent"))).join(counts, "key").drop("key")
        grown = cut(held.where(F.col("freq") / F.col("part_freq") >= min_confidence))
        if grown.isEmpty():
            break
        rows = grown.withColumnRenamed("part_freq", "antecedent_freq")
        found = rows if found is None else found.unionByName(rows)
        grown = grown.select("items", "freq", "consequent", "at")
    if found is None:
        found = grown.withColumnRenamed("part_freq", "antecedent_freq")
    rules = found.withColumn("key", name(F.col("consequent"))).join(counts, "key")
    n = float(max(n_baskets, 1))
    confidence = F.col("freq") / F.col("antecedent_freq")
    return rules.select(
        "antecedent",
        "consequent",
        (F.col("freq") / n).alias("support"),
        confidence.alias("confidence"),
        (confidence / (F.col("part_freq") / n)).alias("lift"),
        (F.col("freq") / n - F.col("antecedent_freq") / n * (F.col("part_freq") / n)).alias("leverage"),
    )
