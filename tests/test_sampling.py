import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.sampling import dense_index, label_encode, pick_per_group, sample_fraction


@pytest.mark.parametrize(("n", "fraction"), [(1000, 0.3), (7, 0.5), (3, 0.1), (500, 1.0), (10, 0.0)])
def test_sample_is_exact_and_repeatable(spark, n, fraction):
    df = spark.range(n).select(F.col("id").cast("string").alias("key"))
    got = sorted(r["key"] for r in sample_fraction(df, ["key"], fraction, 42).collect())
    ranked = sorted((str(i) for i in range(n)), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert got == sorted(ranked[: round(fraction * n)])
    again = sample_fraction(df.repartition(3), ["key"], fraction, 42)
    assert got == sorted(r["key"] for r in again.collect())


def test_dense_index_is_the_sorted_position(spark):
    r = random.Random(1)
    values = [f"{r.choice('aZé0')}{r.randrange(5000)}" for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["idx"] for r in dense_index(df, "v", ranges=16).collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)))}


def test_label_encode_sorts_as_text(spark):
    df = spark.createDataFrame([("1", "x"), ("10", "y"), ("9", "x")], "a string, b string")
    got = sorted((r["a"], r["b"]) for r in label_encode(df, ["a", "b"]).collect())
    assert got == [(0, 0), (1, 1), (2, 0)]


def test_pick_per_group(spark):
    df = spark.createDataFrame([("g", str(i)) for i in range(9)] + [("h", "1")], "g string, k string")
    got = pick_per_group(df, ["g"], "k", 2, 5).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"g": 2, "h": 1}
