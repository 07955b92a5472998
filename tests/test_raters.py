"""Raters that cannot count are neither sent nor looked at; the rest stays exact."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import meet, raters
from shelfwise.operators import predictors as pred

RATING = "user_id string, product_id string, score double"


def split(spark, rows, seed):
    random.Random(seed).shuffle(rows)
    at = len(rows) // 5
    return spark.createDataFrame(rows[at:], RATING), spark.createDataFrame(rows[:at], RATING)


def test_users_go_only_where_a_product_of_theirs_is_shared_and_asked_for(spark, monkeypatch):
    r, copies = random.Random(1), []

    def spy(asked, data, groups, *rest):
        if groups > 1:
            copies.append((data.agg(F.sum(F.size("to"))).first()[0], data.count() * groups))
        return meet.meet(asked, data, groups, *rest)

    monkeypatch.setattr(raters, "meet", spy)
    rows = [
        (f"c{c}u{u}", f"c{c}p{p}", r.randrange(1, 9) / 2)
        for c in range(12) for u in range(15) for p in range(8) if r.random() < 0.5
    ]
    train, test = split(spark, rows, 2)
    narrow = sorted(map(tuple, pred.rating_neighbors(train, test, 3, 4).collect()))
    wide = sorted(map(tuple, pred.rating_neighbors(train, test, 3, 512).collect()))
    assert narrow == wide and narrow
    [(sent, every)] = copies
    assert sent * 2 < every


@pytest.mark.parametrize("dense", [1, 60, 8192])
@pytest.mark.parametrize(("popular", "bounded"), [(1, 0), (64, 200_000)])
def test_the_bound_drops_no_rater(monkeypatch, dense, popular, bounded):
    """The task's own work, with the paths of large blocks forced, against all pairs."""
    import numpy as np
    import pyarrow as pa

    for name, value in (("DENSE", dense), ("POPULAR", popular), ("BOUNDED", bounded), ("MOST", 500)):
        monkeypatch.setattr(raters, name, value)
    within, judged = raters._Overlap.within, []
    monkeypatch.setattr(raters._Overlap, "within", lambda self, most: judged.append(1) or within(self, most))
    r = random.Random(dense)
    scores, asked = {}, {}
    for u in range(90):
        for p in range(25):
            if r.random() < (p + 1) / 40:
                side = asked if r.random() < 0.2 else scores
                side.setdefault(u, {})[p] = r.choice([r.random() * 4, 1.0, 2.0])
    users = sorted(scores)

    def batch(some):
        lists = [pa.array([list(scores[u]) for u in some], pa.list_(pa.int32())),
                 pa.array([list(scores[u].values()) for u in some], pa.list_(pa.float64())),
                 pa.array([list(asked.get(u, {})) for u in some], pa.list_(pa.int32())),
                 pa.array([[str(p) for p in asked.get(u, {})] for u in some], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([str(u) for u in some]), pa.array(some, pa.int64()), *lists], names=["u", "r", "i", "v", "want", "want_id"]
        )

    askers = raters._Askers([batch([u for u in users if u in asked])], 4, 16, [])
    r.shuffle(users)
    for start in range(0, len(users), 32):
        askers.see(batch(users[start : start + 32]))
    got = {}
    for rows in askers.found():
        for x in rows.to_pylist():
            assert x["mean"] == pytest.approx(np.mean(list(scores[int(x["other"])].values())))
            got.setdefault((int(x["user_id"]), int(x["product_id"])), set()).add((int(x["other"]), round(x["sim"], 6)))
    for u in asked:
        for p in asked[u]:
            near = []
            for v in users:
                both = set(scores.get(u, {})) & set(scores[v])
                if p in scores[v] and both:
                    gap = sum((scores[u][i] - scores[v][i]) ** 2 for i in both) / len(both)
                    near.append((-round(1 / (gap + 1), 6), v))
            assert got.get((u, p), set()) == {(v, -s) for s, v in sorted(near)[:4]}, (u, p)
    assert bool(judged) == (popular == 1)


def test_neighbour_models_follow_from_one_table_of_sums(spark):
    r = random.Random(3)
    rows = [(f"u{u}", f"p{p}", r.randrange(1, 9) / 2) for u in range(14) for p in range(9) if r.random() < 0.6]
    train, test = split(spark, rows, 4)
    base = pred.fit_baselines(train)
    near = pred.rating_neighbors(train, test, carry=base.users)
    plain = near.select("user_id", "product_id", "other", "sim", "score")
    sums = pred.neighbor_sums(near)
    assert "other" not in sums.columns

    def values(df):
        return {(x["user_id"], x["product_id"]): round(x["est"], 9) for x in df.collect()}

    assert values(pred.knn_basic(train, test, sums)) == values(pred.knn_basic(train, test, plain))
    assert values(pred.knn_means(train, test, sums)) == values(pred.knn_means(train, test, plain))
    alone = values(pred.knn_baseline(train, test, plain, base))
    assert values(pred.knn_baseline(train, test, sums, base)) == alone == values(pred.knn_baseline(train, test))
