"""Terms of many texts are counted in parts of bounded size, with one shuffle by document."""

from pyspark.sql import functions as F

from shelfwise.operators import text
from shelfwise.operators import vectors as vec


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_are_dealt_into_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(text, "TASK_CHARS", 100)
    rows = [(str(i % 40), f"word{i} again") for i in range(200)] + [(None, "no name"), ("x", None)]
    docs = spark.createDataFrame(rows, "doc string, text string").coalesce(1)
    texts, n = text.dealt(docs, "doc", F.col("text"))
    chars = sum(len(t or "") for _, t in rows)
    assert n == 202 and texts.rdd.getNumPartitions() == -(-chars // 100)
    assert sorted(map(str, texts.collect())) == sorted(map(str, docs.collect()))


def test_weights_shuffle_texts_and_no_terms(spark):
    rows = [("a", "one two two"), ("a", "two three"), ("b", "one one"), (None, "two four"), (None, "four"), ("e", None)]
    docs = spark.createDataFrame(rows, "doc string, text string")
    found = text.tfidf_weights(docs, "doc", min_df=1, max_df=1.0)
    assert shuffles(found) == 1
    assert {(r["doc"], r["term"], r["tf"]) for r in found.collect()} == {
        ("a", "one", 1), ("a", "two", 3), ("a", "three", 1), ("b", "one", 2), (None, "two", 1), (None, "four", 2),
    }


def test_hashed_vectors_count_in_the_parts_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(text, "TASK_CHARS", 20)
    schema = "product_id string, name string, category string, type string, description string"
    rows = [(str(i), f"name{i}", "c", "t", "more words") for i in range(30)]
    found = vec.hashed_vectors(spark.createDataFrame(rows, schema).coalesce(1))
    parts = [p for p in found._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")][:-1]
    assert parts and all("hashpartitioning(product_id" in p for p in parts)
    assert found.count() == 30
