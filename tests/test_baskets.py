import pytest

from shelfwise.operators import baskets as bk
from shelfwise.plans.cart import cart_matches, cart_recommend


def lines(spark, baskets):
    rows = [(str(i), p) for i, b in enumerate(baskets) for p in b]
    return spark.createDataFrame(rows, "user_session string, product_id string")


def test_golden_rule(spark):
    # Two baskets lose all their items: "e" and "f" are too rare, but the baskets still count.
    baskets = bk.prepare_baskets(lines(spark, ["abc", "abc", "ab", "ef", "aa"]), 1.0, min_item_count=2)
    rules = {
        ("".join(r["antecedent"]), r["consequent"]): r
        for r in bk.basket_rules(bk.mine(baskets, 0.001, 0.08)).collect()
    }
    r = rules["a", "b"]
    assert (r["support"], r["confidence"], r["lift"]) == pytest.approx((0.6, 0.75, 1.25))
    assert r["score"] == pytest.approx(0.9375)


def test_length_counts_repeats_and_items_are_distinct(spark):
    baskets = bk.prepare_baskets(lines(spark, ["aa", "a", "ab"]), 1.0, min_item_count=1)
    assert baskets.ids.count() == 2
    assert sorted((r["basket"], r["item"]) for r in baskets.items.collect()) == [
        ("0", "a"), ("2", "a"), ("2", "b")
    ]


RULES = [
    (["a"], "b", 0.9), (["a", "c"], "d", 2.0), (["a", "c"], "b", 1.5), (["x"], "z", 3.0), (["b"], "a", 0.5),
]


def rules(spark):
    return spark.createDataFrame(RULES, "antecedent array<string>, consequent string, score double")


def recommend(spark, carts, k=5):
    df = spark.createDataFrame(carts, "cart string, cart_items array<string>")
    out = {}
    for r in cart_recommend(rules(spark), df, k).orderBy("cart", "rank").collect():
        out.setdefault(r["cart"], []).append(r["product_id"])
    return out


def test_rules_first_then_the_fill_pool(spark):
    got = recommend(
        spark,
        [("1", ["a", "c"]), ("2", ["a"]), ("3", ["q"]), ("4", []), ("5", ["a", "b", "d", "z"]), ("6", ["c", "a", "a"])],
    )
    assert got["1"] == ["d", "b", "z"]  # "a" is in the cart
    assert got["2"] == ["b", "z", "d"]  # fill by score, without what is listed already
    assert got["3"] == ["z", "d", "b", "a"]
    assert "4" not in got  # an empty cart is no request
    assert "5" not in got  # the cart covers every consequent
    assert got["6"] == got["1"]


def test_k_per_request_and_in_general(spark):
    assert recommend(spark, [("1", ["a", "c"])], 1) == {"1": ["d"]}
    df = spark.createDataFrame([("1", ["q"], 2), ("2", ["q"], 3)], "cart string, cart_items array<string>, k int")
    got = cart_recommend(rules(spark), df).groupBy("cart").count().collect()
    assert {r["cart"]: r["count"] for r in got} == {"1": 2, "2": 3}


def test_matches_need_the_whole_antecedent(spark):
    df = spark.createDataFrame([("1", ["c"]), ("2", ["a", "c"])], "cart string, cart_items array<string>")
    got = {(r["cart"], "".join(r["antecedent"]), r["consequent"]) for r in cart_matches(rules(spark), df).collect()}
    assert got == {("2", "a", "b"), ("2", "ac", "d"), ("2", "ac", "b")}


def test_matches_stay_with_their_cart(spark):
    df = spark.createDataFrame([("1", ["c"]), ("2", ["a", "c"])], "cart string, cart_items array<string>")
    per_cart = cart_matches(rules(spark), df).groupBy("cart", "consequent").count().groupBy("cart").count()
    plan = per_cart._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the carts themselves


def test_equal_carts_are_matched_once(spark):
    from shelfwise.plans.cart import equal_carts

    rows = [("1", ["c", "a"]), ("2", ["a", "c", "a"]), ("3", ["b"]), (None, ["b"]), ("4", [])]
    carts, unique = equal_carts(spark.createDataFrame(rows, "cart string, cart_items array<string>"))
    assert sorted(r["cart_items"] for r in unique.collect()) == [[], ["a", "c"], ["b"]]
    assert {(r["cart"], tuple(r["key"])) for r in carts.collect()} == {
        ("1", ("a", "c")), ("2", ("a", "c")), ("3", ("b",)), (None, ("b",)), ("4", ()),
    }
