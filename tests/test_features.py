import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import features as ft
from shelfwise.schemas import BEHAVIORS

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def events(spark, rows):
    """rows: (seconds, type, product[, user, session])"""
    full = []
    for r in rows:
        sec, kind, product, user, session = (*r, "u1", "s1")[:5] if len(r) == 3 else r
        full.append(
            ("x", T0 + dt.timedelta(seconds=sec), kind, product, user, session, "a.b", "br", f"n{product}", 1.5)
        )
    return spark.createDataFrame(full, BEHAVIORS)


GOLDEN = [(0, "view", "A"), (10, "view", "A"), (40, "cart", "A"), (100, "view", "B")]


def rows_of(df):
    return [
        (r["product_id"], r["event_time"], r["F1"], r["F2"], r["F3"], r["F4"], r["duration"], r["total_duration"])
        for r in df.orderBy("user_id", "user_session", "event_time", "product_id").collect()
    ]


def test_golden_session(spark):
    got = ft.session_features(ft.clean_events(events(spark, GOLDEN)))
    assert [(r[0], *map(lambda x: round(x, 6), r[2:])) for r in rows_of(got)] == [
        ("A", 0.666667, 1.0, 0.0, 0.0, 0.0, 100.0),
        ("A", 0.666667, 1.0, 0.0, 0.1, 10.0, 100.0),
        ("A", 0.666667, 1.0, 0.0, 0.3, 30.0, 100.0),
        ("B", 0.333333, 0.0, 0.0, 0.6, 60.0, 100.0),
    ]
    scores = {r["product_id"]: r["score"] for r in ft.user_product_scores(got).collect()}
    assert scores == pytest.approx({"A": 1.18, "B": 0.1 / 3 + 0.12})


def test_repeated_rows_count_but_stay_once(spark):
    got = ft.session_features(ft.clean_events(events(spark, [GOLDEN[0], *GOLDEN]))).collect()
    assert len(got) == 4
    assert {(r["product_id"], r["is_view"], r["total_view"]) for r in got} == {("A", 3, 4), ("B", 1, 4)}


def test_zero_and_missing_values_delete_the_row(spark):
    bad = [("0", "u", "s"), ("p", "0", "s"), ("p", "u", "0"), (None, "u", "s"), ("p", "u", "s")]
    df = events(spark, [(0, "view", p, u, s) for p, u, s in bad])
    assert ft.clean_events(df).count() == 1
    assert ft.clean_events(df.withColumn("price", F.lit(0.0))).count() == 0
    assert ft.clean_events(df.withColumn("price", F.lit(float("nan")))).count() == 0
    assert ft.clean_events(df).first()["category_code"] == "a b"
    with pytest.raises(ValueError, match="eventTime"):
        ft.clean_events(df.drop("eventTime"))


def test_single_event_session_has_no_dwell_time(spark):
    row = ft.session_features(ft.clean_events(events(spark, [(5, "error", "A")]))).first()
    assert (row["F1"], row["F2"], row["F3"], row["F4"], row["total_duration"]) == (0, 0, 0, 0, 0)


def random_events(spark, seed, n=400):
    r = random.Random(seed)
    kinds = ["view", "cart", "purchase", "signup"]
    rows = [
        (r.randrange(2000), r.choice(kinds), f"p{r.randrange(12)}", f"u{r.randrange(3)}", f"s{r.randrange(3)}")
        for _ in range(n)
    ]
    # The copies keep the order of tied rows the same on both paths.
    seen, unique = set(), []
    for row in rows:
        if (row[0], row[3], row[4]) not in seen:
            seen.add((row[0], row[3], row[4]))
            unique.append(row)
    return events(spark, unique + unique[:20])


@pytest.mark.parametrize("limit", [3, 25])
def test_hot_sessions_give_the_same_features(spark, limit):
    clean = ft.clean_events(random_events(spark, limit))
    plain, split = ft.session_features(clean), ft.session_features(clean, session_rows=limit)
    assert sorted(split.columns) == sorted(plain.columns)
    cols = sorted(plain.columns)
    a = sorted(map(repr, plain.select(cols).collect()))
    assert a == sorted(map(repr, split.select(cols).collect()))


def test_shares_add_up(spark):
    df = ft.session_features(ft.clean_events(random_events(spark, 1)))
    f4 = df.groupBy("user_id", "user_session").agg(F.sum("F4").alias("x")).collect()
    assert all(abs(r["x"] - 1) < 1e-9 or r["x"] == 0 for r in f4)
    f1 = df.select("user_id", "user_session", "product_id", "F1").distinct()
    f1 = f1.groupBy("user_id", "user_session").agg(F.sum("F1").alias("x")).collect()
    assert all(abs(r["x"] - 1) < 1e-9 or r["x"] == 0 for r in f1)


def test_recent_sessions_clamp_the_month(spark):
    rows = [
        ("x", dt.datetime(2024, 5, 31), "view", "A", "u", "s1", "c", "b", "n", 1.0),
        ("x", dt.datetime(2024, 2, 29), "view", "A", "u", "s2", "c", "b", "n", 1.0),
        ("x", dt.datetime(2024, 2, 28), "view", "A", "u", "s3", "c", "b", "n", 1.0),
    ]
    got = ft.recent_sessions(spark.createDataFrame(rows, BEHAVIORS)).collect()
    assert sorted(r["user_session"] for r in got) == ["s1", "s2"]
    assert {str(r["cutoff"]) for r in got} == {"2024-02-29 00:00:00"}


def test_features_shuffle_events_once_when_no_session_is_hot(spark):
    """All windows of the ordinary path share one exchange."""
    plan = ft._ordinary_sessions(ft.clean_events(events(spark, GOLDEN)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_hot_path_is_not_planned_without_hot_sessions(spark):
    plan = ft.session_features(ft.clean_events(events(spark, GOLDEN)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
