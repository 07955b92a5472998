"""Iterative fits by value: planted structure, signs, normal equations and folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import factors as fac
from shelfwise.operators.baselines import fit_baselines, predict_baselines

RATING = "user_id string, product_id string, score double"


def planted(spark, users=24, items=18, drop=5):
    """Offsets plus one factor; every fifth pair is left out."""
    r = np.random.default_rng(5)
    p, q = r.choice([-1.0, 1.0], users), r.choice([-1.0, 1.0], items)
    rows = [
        (f"u{u}", f"i{i}", float(3 + 0.8 * p[u] * q[i]))
        for u in range(users)
        for i in range(items)
    ]
    train = [x for k, x in enumerate(rows) if k % drop]
    test = [x for k, x in enumerate(rows) if not k % drop]
    return spark.createDataFrame(train, RATING), spark.createDataFrame(test, RATING)


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("score") - F.col("est")) ** 2))).first()[0]


def test_factors_find_what_offsets_cannot(spark):
    train, test = planted(spark)
    base = fit_baselines(train)
    alone = rmse(predict_baselines(base, test))
    model = fac.fit_factors(train, base, rank=2, regParam=0.02, maxIter=10)
    assert alone > 0.6 and rmse(fac.predict_factors(model, test)) < 0.25
    assert {len(r.p) for r in model.users.collect()} == {2}


def test_last_half_step_solves_the_normal_equations(spark):
    """With the user factors fixed, no item factor can be better: items are fitted after users or
    users after items, so one of the two sides is at its optimum."""
    train, _ = planted(spark, 10, 8)
    reg = 0.1
    model = fac.fit_factors(train, rank=2, regParam=reg, maxIter=4)
    left = predict_baselines(model.base, train).withColumn("left", F.col("score") - F.col("raw"))
    rows = left.select("user_id", "product_id", "left").collect()
    p = {r.user_id: np.array(r.p, float) for r in model.users.collect()}
    q = {r.product_id: np.array(r.q, float) for r in model.items.collect()}

    def gap(own, other, key, far):
        worst = 0.0
        for name, v in own.items():
            mine = [r for r in rows if r[key] == name]
            m = np.array([other[r[far]] for r in mine])
            y = np.array([r["left"] for r in mine])
            best = np.linalg.solve(m.T @ m + reg * len(mine) * np.eye(2), m.T @ y)
            worst = max(worst, float(np.abs(best - v).max()))
        return worst

    assert min(gap(q, p, "product_id", "user_id"), gap(p, q, "user_id", "product_id")) < 1e-3


def test_non_negative_factors_stay_in_the_range(spark):
    train, test = planted(spark)
    found = fac.nmf_scores(train, test.unionByName(spark.createDataFrame([("new", "i0", 3.0)], RATING)))
    est = {(r.user_id, r.product_id): r.est for r in found.collect()}
    mean = train.agg(F.avg("score")).first()[0]
    assert est["new", "i0"] == pytest.approx(mean)
    assert all(2.2 <= v <= 3.8 for v in est.values())
    assert rmse(found.where("user_id <> 'new'")) < 0.9


def test_grid_search_refits_with_the_best_setting(spark):
    train, test = planted(spark)
    grid = [{"rank": 1, "regParam": 10.0}, {"rank": 2, "regParam": 0.02}]
    errors, model = fac.best_factors(train, grid, folds=3, epochs=3)
    rows = {r.params: r for r in errors.collect()}
    assert len(rows) == 2
    best = rows[str(sorted(grid[1].items()))]
    assert best.best_rmse and best.rmse < min(r.rmse for r in rows.values()) + 1e-9
    assert {len(r.p) for r in model.users.collect()} == {2} and rmse(fac.predict_factors(model, test)) < 0.35


def test_coclustering_follows_its_epochs(spark):
    """The same assignments and means in plain Python, epoch by epoch."""
    import hashlib

    from shelfwise.operators.predictors import coclustering

    r = np.random.default_rng(8)
    rows = {
        (f"u{u}", f"i{i}"): float(round(1 + u % 3 + (i % 2) * 0.7 + r.normal(0, 0.3), 3))
        for u in range(15)
        for i in range(12)
        if r.random() < 0.6
    }
    names = sorted(rows)
    train, test = {k: rows[k] for k in names[::2] + names[1::4]}, {k: rows[k] for k in names[3::4]}
    test["new", "i0"] = 2.0
    train = {k: v for k, v in train.items() if k not in test}
    users, items = sorted({u for u, _ in train}), sorted({i for _, i in train})
    pick = lambda x: int(hashlib.md5(f"42:{x}".encode()).hexdigest()[:8], 16) % 3
    g, h = {u: pick(u) for u in users}, {i: pick(i) for i in items}
    mean = np.mean(list(train.values()))

    def average(of):
        found = {}
        for (u, i), s in train.items():
            found.setdefault(of(u, i), []).append(s)
        return {k: np.mean(v) for k, v in found.items()}

    by_user, by_item = average(lambda u, i: u), average(lambda u, i: i)

    def means():
        return average(lambda u, i: (g[u], h[i])), average(lambda u, i: g[u]), average(lambda u, i: h[i])

    def estimate(t, u, i, a, b):
        cell, rows_, columns = t
        return cell.get((a, b), mean) + by_user[u] - rows_.get(a, mean) + by_item[i] - columns.get(b, mean)

    for _ in range(20):
        t, before = means(), (dict(g), dict(h))
        for u in users:
            g[u] = min(
                (sum((s - estimate(t, u, i, c, h[i])) ** 2 for (v, i), s in train.items() if v == u), c)
                for c in range(3)
            )[1]
        for i in items:
            h[i] = min(
                (sum((s - estimate(t, u, i, g[u], c)) ** 2 for (u, j), s in train.items() if j == i), c)
                for c in range(3)
            )[1]
        if before == (g, h):
            break
    t = means()
    low, high = min(train.values()), max(train.values())
    frame = lambda d: spark.createDataFrame([(u, i, s) for (u, i), s in d.items()], RATING)
    got = {(x.user_id, x.product_id): x.est for x in coclustering(frame(train), frame(test)).collect()}
    for u, i in test:
        if u in g and i in h:
            want = min(max(estimate(t, u, i, g[u], h[i]), low), high)
            assert got[u, i] == pytest.approx(want)
    assert len(got) == len(test) and got["new", "i0"] == pytest.approx(min(max(by_item["i0"], low), high))
