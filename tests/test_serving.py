"""Keyed tables, and answers from them next to those worked out from the history."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from shelfwise.operators.features import clean_events, product_details
from shelfwise.plans import cart, cold, personal, train
from shelfwise.sources.artifacts import read_model
from shelfwise.sources.keyed import lookup, write_keyed
from shelfwise.storage import cut
from shelfwise.streaming import requests as serving


def test_lookups_open_the_folders_of_their_keys(spark, tmp_path):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).cast("string").alias("k"), F.col("id").alias("v")
    )
    path = str(tmp_path / "t")
    write_keyed(rows, path, ["k"], bucket_rows=50)
    wanted = spark.createDataFrame([("7",), ("1600",), ("1600",), ("none",), (None,)], "k string")
    found = lookup(spark, path, wanted)
    assert found.columns == ["k", "v"] and found.count() == 1501
    assert sorted({r.k for r in found.collect()}) == ["1600", "7"]
    read = {f.split("hash_of_key=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(read) <= 4
    assert lookup(spark, path, wanted.limit(0)).count() == 0


def test_an_empty_table_is_looked_up(spark, tmp_path):
    write_keyed(spark.createDataFrame([], "a string, b long"), str(tmp_path / "t"), ["a"])
    found = lookup(spark, str(tmp_path / "t"), spark.createDataFrame([("x",)], "a string"))
    assert found.columns == ["a", "b"] and found.count() == 0


@pytest.fixture(scope="module")
def trained(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("served"))
    events = cut(clean_events(fx.behaviors(spark, sf)))
    names = train.train_all(fx.behaviors(spark, sf), fx.catalog(spark, sf), root)
    names = {k: v for k, v in names.items() if k != train.SERVING}
    names[train.SERVING] = train.train_serving(events, root, names, bucket_rows=20)
    train.announce(spark, root, names)
    return root, names, events


def listed(df, key="target"):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r[key], []).append(r["product_id"])
    return out


def test_answers_equal_those_from_the_history(spark, trained):
    root, names, events = trained
    details = cut(product_details(events))
    pairs = events.select("user_id", "product_id").distinct().orderBy("user_id", "product_id").limit(12).collect()
    rows = [("session", f"s{i}", r.user_id, r.product_id, None, None) for i, r in enumerate(pairs)]
    rows += [("session", f"u{i}", "nobody", r.product_id, None, None) for i, r in enumerate(pairs[:4])]
    rows += [("anonymous", f"a{i}", None, r.product_id, None, None) for i, r in enumerate(pairs[:4])]
    rows += [("cart", f"c{i}", None, None, [r.product_id, pairs[0].product_id], 4) for i, r in enumerate(pairs[:5])]
    rows += [("session", "x", "nobody", "no such product", None, None), ("cart", "y", None, None, None, None)]
    got = cut(serving.answer(spark, root, spark.createDataFrame(rows, serving.REQUEST)))
    assert {r.request_id for r in got.collect()} == {r[1] for r in rows}
    assert [r.status for r in got.where("request_id in ('x', 'y')").collect()] == ["not found"] * 2
    answers = listed(got.where("status = 'found'"), "request_id")

    factors = train.read_factors(spark, root, names[train.COLLABORATIVE])
    wanted = spark.createDataFrame([(r.user_id, r.product_id) for r in pairs], "user_id string, product_id string")
    full = personal.personal_recommend(wanted, events, factors, details)
    full = listed(full.withColumn("key", F.concat_ws(" ", "user_id", "target")), "key")
    for i, r in enumerate(pairs):
        assert answers.get(f"s{i}") == full.get(f"{r.user_id} {r.product_id}")

    clusters = read_model(spark, root, names[train.COLDSTART])
    targets = spark.createDataFrame([(r.product_id,) for r in pairs[:4]], "product_id string")
    unknown = listed(cold.cold_recommend(targets, clusters, details))
    nameless = listed(cold.anonymous_recommend(targets, clusters, details))
    for i, r in enumerate(pairs[:4]):
        assert answers[f"u{i}"] == unknown[r.product_id] and answers[f"a{i}"] == nameless[r.product_id]

    carts = [(f"c{i}", [r.product_id, pairs[0].product_id], 4) for i, r in enumerate(pairs[:5])]
    carts = spark.createDataFrame(carts, "cart string, cart_items array<string>, k int")
    want = listed(cart.cart_recommend(read_model(spark, root, names[train.RULES]), carts), "cart")
    assert {k: v for k, v in answers.items() if k[0] == "c"} == want


def test_a_few_requests_read_a_few_folders(spark, trained, monkeypatch):
    """Ten requests open at most as many folders of a table as they have keys in it."""
    root, _, events = trained
    opened = []

    def watched(session, path, wanted):
        found = lookup(session, path, wanted)
        folders = {f.split("hash_of_key=")[1].split("/")[0] for f in found.inputFiles() if "hash_of_key=" in f}
        opened.append((path.rsplit("/", 1)[1], len(folders), wanted.distinct().count()))
        return found

    monkeypatch.setattr(serving, "lookup", watched)
    some = events.select("product_id").distinct().orderBy("product_id").limit(10).collect()
    rows = [("anonymous", f"a{i}", None, r.product_id, None, None) for i, r in enumerate(some)]
    serving.answer(spark, root, spark.createDataFrame(rows, serving.REQUEST)).count()
    assert {"details", "names", "clusters", "listed"} <= {t for t, _, _ in opened}
    assert all(folders <= max(keys, 1) for _, folders, keys in opened)
