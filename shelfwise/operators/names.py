"""Products of the same category and brand, and the closest of them by name."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import rounded, tokens
from ..storage import cut, spread
from .text import idf

GROUP = ["category_code", "brand"]

# Fixed value: products in a full recommendation list.
LIST_SIZE = 10


def _first_ids(details: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """The smallest ``slots`` ids per key, as an array; the limit is applied before the shuffle."""
    order = Window.partitionBy(*keys).orderBy("product_id")
    ranked = details.select(*keys, "product_id").withColumn("n", F.row_number().over(order))
    return ranked.where(F.col("n") <= slots).groupBy(*keys).agg(
        F.array_sort(F.collect_list("product_id")).alias("ids")
    )


def same_category_brand(details: DataFrame, n: int = LIST_SIZE) -> DataFrame:
    """target, rank, candidate: the first n other products of the same category and brand."""
    first = _first_ids(details, GROUP, n + 1)
    others = F.slice(F.array_remove("ids", F.col("product_id")), F.lit(1), F.lit(n))
    return (
        details.join(first, GROUP)
        .select(F.col("product_id").alias("target"), F.posexplode(others).alias("pos", "candidate"))
        .select("target", (F.col("pos") + 1).alias("rank"), "candidate")
    )


def _name_classes(details: DataFrame, slots: int, stop_words: list[str]) -> DataFrame:
    """Distinct names per group: first ids, and terms with their counts and group frequency.

    Products that share a name are compared once. ``n`` is the number of products in the group.
    """
    named = details.select(*GROUP, "product_id", F.coalesce("name", F.lit("")).alias("name"))
    stop = F.array(*[F.lit(w) for w in stop_words])
    copies = named.groupBy(*GROUP, "name").agg(F.count(F.lit(1)).alias("copies"))
    words = copies.withColumn("w", F.filter(tokens(F.col("name")), lambda x: ~F.array_contains(stop, x)))
    terms = words.select(*GROUP, "name", "copies", F.explode("w").alias("term"))
    tf = terms.groupBy(*GROUP, "name", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.any_value("copies").alias("copies")
    )
    df = tf.groupBy(*GROUP, "term").agg(F.sum("copies").alias("df"))
    arrays = tf.join(df, [*GROUP, "term"]).groupBy(*GROUP, "name").agg(
        F.array_sort(F.collect_list(F.struct("term", "tf", "df"))).alias("terms")
    )
    size = copies.groupBy(*GROUP).agg(F.sum("copies").alias("n"))
    empty = F.array().cast("array<struct<term:string,tf:bigint,df:bigint>>")
    return (
        _first_ids(named, [*GROUP, "name"], slots)
        .join(arrays, [*GROUP, "name"], "left")
        .join(size, GROUP)
        .withColumn("terms", F.coalesce("terms", empty))
    )


def _removed_terms(targets: DataFrame, details: DataFrame, stop_words: list[str]) -> DataFrame:
    """target, gone, gone_df: products of the target's own group that are excluded from its
    corpus, and how many of them hold each term. Bounded by the excluded lists."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    kept = F.array_distinct(F.filter(tokens(F.col("x_name")), lambda x: ~F.array_contains(stop, x)))
    x = details.select(
        F.col("product_id").alias("x"), *[F.col(g).alias(f"x_{g}") for g in GROUP],
        F.coalesce("name", F.lit("")).alias("x_name"),
    )
    listed = targets.select("target", *GROUP, F.explode("excluded").alias("x"))
    listed = listed.where(F.col("x") != F.col("target")).join(x, "x")
    for g in GROUP:
        listed = listed.where(F.col(g) == F.col(f"x_{g}"))
    docs = listed.groupBy("target").agg(F.count(F.lit(1)).alias("gone"))
    terms = listed.select("target", F.explode(kept).alias("term"))
    counts = terms.groupBy("target", "term").agg(F.count(F.lit(1)).alias("c"))
    maps = counts.groupBy("target").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "c"))).alias("gone_df")
    )
    return docs.join(maps, "target", "left")


def similar_names(
    targets: DataFrame,
    details: DataFrame,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """target, rank, product_id, similarity: the closest names in the target's category and brand.

    ``targets`` has target, excluded (array of ids) and needed (int); the first ids kept per
    name and group follow from the longest list and the largest number in it. The corpus of a target is its own name and all names of its group that are
    not excluded; document frequencies are those of the group less the excluded names. Only names
    that share a term with the target are compared, each pair once; the others have similarity 0
    and follow in id order, for which a few first ids per group are enough.

    Targets of one group with the same name, exclusions and number are answered once, with one product
    more than asked for, since each of them leaves itself out. Only as many names are kept as
    products are needed: every closer name brings at least one product.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    targets = cut(targets)
    most = targets.agg(F.max("needed"), F.max(F.size("excluded"))).first()
    needed = most[0] or 0
    slots = needed + max(most[1] or 0, 0) + 1
    classes = cut(_name_classes(details, slots, stop_words))
    own = details.select(
        F.col("product_id").alias("target"), *GROUP, F.coalesce("name", F.lit("")).alias("name")
    )
    asked = targets.where(F.col("needed") > 0).join(own, "target").withColumn(
        "excluded", F.array_sort(F.array_except("excluded", F.array("target")))
    )
    # Rows that repeat a target repeat what it excludes.
    kind = [*GROUP, "name", "excluded", "needed"]
    asked = asked.groupBy("target", *kind).agg(F.count(F.lit(1)).alias("times"))
    asked = cut(asked.withColumn("kind", F.sha2(F.to_json(F.struct(*kind, "times")), 256)))
    members = asked.select("kind", F.col("target").alias("member"), F.col("needed").alias("wanted"))
    first = [F.any_value(c).alias(c) for c in (*kind, "times")]
    asked = asked.groupBy(F.col("kind").alias("target")).agg(*first)
    asked = asked.withColumn("needed", F.col("needed") + 1)
    gone = _removed_terms(asked, details, stop_words)
    none = F.create_map().cast("map<string,bigint>")
    asked = asked.join(classes.select(*GROUP, "name", "n", F.col("terms").alias("mine")), [*GROUP, "name"])
    asked = asked.join(gone, "target", "left").select(
        "target", *GROUP, "excluded", "needed", "mine",
        (F.col("n") - F.col("times") * F.coalesce("gone", F.lit(0))).cast("double").alias("n_t"),
        F.transform_values(F.coalesce("gone_df", none), lambda _, c: c * F.col("times")).alias("gone_df"),
    )
    asked = cut(asked)

    def weight(t: Column) -> Column:
        df = t["df"] - F.coalesce(F.col("gone_df")[t["term"]], F.lit(0))
        return t["tf"] * idf(F.col("n_t"), df)

    def weighted(arr: str) -> Column:
        return F.map_from_entries(F.transform(arr, lambda t: F.struct(t["term"], weight(t))))

    def length(arr: str) -> Column:
        return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, t: s + weight(t) * weight(t)))

    left = asked.withColumns({"mine_w": weighted("mine"), "mine_len": length("mine")})
    left = left.withColumn("term", F.explode(F.transform("mine", lambda t: t["term"])))
    right = classes.select(
        *GROUP, "ids", "terms", F.explode(F.transform("terms", lambda t: t["term"])).alias("term")
    )
    shared = F.array_intersect(
        F.map_keys("mine_w"), F.transform("terms", lambda t: t["term"])
    )
    dot = F.aggregate(
        "terms",
        F.lit(0.0),
        lambda s, t: s + F.coalesce(F.col("mine_w")[t["term"]], F.lit(0.0)) * weight(t),
    )
    # Names meet by group and term; the work grows far beyond the bytes of either side.
    on = [*GROUP, "term"]
    pairs = spread(left, *on).join(spread(right, *on), on).where(F.array_min(shared) == F.col("term"))
    close = pairs.select(
        "target", "needed", rounded(dot / (F.col("mine_len") * length("terms"))).alias("similarity"),
        F.filter("ids", lambda x: ~F.array_contains("excluded", x)).alias("ids"),
    ).where(F.size("ids") > 0)
    by_first = Window.partitionBy("target").orderBy(F.desc("similarity"), F.element_at("ids", 1))
    close = close.withColumn("n", F.row_number().over(by_first)).where(F.col("n") <= needed + 1)
    close = close.where(F.col("n") <= F.col("needed")).select(
        "target", "needed", "similarity", F.explode("ids").alias("product_id")
    )
    far = asked.join(_first_ids(details, GROUP, slots), GROUP).select(
        "target", "needed", F.lit(0.0).alias("similarity"),
        F.explode(F.filter("ids", lambda x: ~F.array_contains("excluded", x))).alias("product_id"),
    )
    best = close.unionByName(far).groupBy("target", "product_id").agg(
        F.max("similarity").alias("similarity"), F.any_value("needed").alias("needed")
    )
    order = Window.partitionBy("target").orderBy(F.desc("similarity"), "product_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= needed + 1)
    answers = cut(ranked.where(F.col("rank") <= F.col("needed")).select(F.col("target").alias("kind"), "product_id", "similarity"))
    # A target whose rows differ has several kinds.
    each = members.join(answers, "kind").where(F.col("product_id") != F.col("member"))
    each = each.groupBy(F.col("member").alias("target"), "product_id").agg(
        F.max("similarity").alias("similarity"), F.any_value("wanted").alias("needed")
    )
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= needed)
    return ranked.where(F.col("rank") <= F.col("needed")).select(
        "target", "rank", "product_id", "similarity"
    )


def name_similarity(details: DataFrame, targets: DataFrame | None = None, n: int = LIST_SIZE) -> DataFrame:
    """The n closest names for each target product (all products when none are given)."""
    wanted = (details if targets is None else targets).select(F.col("product_id").alias("target"))
    wanted = wanted.distinct().select(
        "target", F.array().cast("array<string>").alias("excluded"), F.lit(n).alias("needed")
    )
    return similar_names(wanted, details)
