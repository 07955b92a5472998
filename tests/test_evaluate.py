import pytest

from shelfwise.operators import baselines as base
from shelfwise.operators import evaluate as ev
from shelfwise.operators import predictors as pred
from shelfwise.operators import weights as wt

PAIR = "user_id string, product_id string"


def test_golden_micro_f1(spark):
    lists = spark.createDataFrame([("u1", "A"), ("u1", "B"), ("u1", "C"), ("u2", "E")], PAIR)
    truth = spark.createDataFrame([("u1", "A"), ("u1", "D"), ("u2", "E"), ("u3", "A")], PAIR)
    r = ev.micro_f1(lists, truth).first()
    assert (r["hits"], r["recommended"], r["actual"]) == (2, 4, 3)
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((0.5, 2 / 3, 4 / 7))


def test_empty_lists_score_zero(spark):
    none = spark.createDataFrame([], PAIR)
    r = ev.micro_f1(none, spark.createDataFrame([("u", "A")], PAIR)).first()
    assert (r["hits"], r["f1"]) == (0, 0.0)


def test_user_precision_uses_the_smaller_denominator(spark):
    lists = spark.createDataFrame([("u1", "A"), ("u1", "B"), ("u1", "C"), ("u2", "E")], PAIR)
    truth = spark.createDataFrame([("u1", "A"), ("u1", "D"), ("u2", "F")], PAIR)
    got = {r["user_id"]: r["precision"] for r in ev.user_precision(lists, truth).collect()}
    assert got == {"u1": 0.5, "u2": 0.0}


def test_threshold_is_three_and_users_do_not_mix(spark):
    rows = [(f"u{u}", f"p{i}", "purchase") for u in range(20) for i in range(u % 4 + 1)]
    events = spark.createDataFrame(rows, PAIR + ", event_type string")
    eligible = {r["user_id"] for r in ev.eligible_users(events).collect()}
    assert eligible == {f"u{u}" for u in range(20) if u % 4 >= 2}
    users = ev.holdout_users(events, 0.5)
    test, train = ev.split_by_user(events, users)
    a = {r["user_id"] for r in test.collect()}
    b = {r["user_id"] for r in train.collect()}
    assert len(a) == 5 and a <= eligible and not a & b and len(a | b) == 20


RATINGS = [("u1", "A", 1.0), ("u1", "B", 3.0), ("u2", "A", 2.0), ("u2", "C", 4.0), ("u3", "B", 5.0)]


def ratings(spark, rows=RATINGS):
    return spark.createDataFrame(rows, PAIR + ", score double")


def offsets(rows, epochs, reg_u=15.0, reg_i=10.0):
    mu = sum(r[2] for r in rows) / len(rows)
    bu, bi = {}, {}
    for _ in range(epochs):
        for i in {r[1] for r in rows}:
            mine = [r for r in rows if r[1] == i]
            bi[i] = sum(r[2] - mu - bu.get(r[0], 0) for r in mine) / (reg_i + len(mine))
        for u in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == u]
            bu[u] = sum(r[2] - mu - bi[r[1]] for r in mine) / (reg_u + len(mine))
    return mu, bu, bi


@pytest.mark.parametrize("epochs", [1, 3, 11])
def test_offsets_match_the_plain_loop(spark, epochs):
    model = base.fit_baselines(ratings(spark), epochs=epochs)
    mu, bu, bi = offsets(RATINGS, epochs)
    assert model.mean["score"] == pytest.approx(mu)
    assert {r["user_id"]: r["b_u"] for r in model.users.collect()} == pytest.approx(bu)
    assert {r["product_id"]: r["b_i"] for r in model.items.collect()} == pytest.approx(bi)


def test_unknown_ids_drop_only_their_own_terms(spark):
    model = base.fit_baselines(ratings(spark))
    mu, bu, bi = offsets(RATINGS, 10)
    asked = spark.createDataFrame([("x", "A"), ("u1", "y"), ("x", "y")], PAIR)
    got = {(r["user_id"], r["product_id"]): r["est"] for r in base.predict_baselines(model, asked).collect()}
    assert got == pytest.approx({("x", "A"): mu + bi["A"], ("u1", "y"): mu + bu["u1"], ("x", "y"): mu})


def test_predictors_on_unknown_users(spark):
    train, mean = ratings(spark), 3.0
    test = ratings(spark, [("x", "A", 1.0), ("u1", "C", 2.0), ("u3", "Z", 2.0)])
    basic = {r["user_id"]: r["est"] for r in pred.knn_basic(train, test).collect()}
    assert basic == pytest.approx({"x": mean, "u1": 4.0, "u3": mean})
    means = {r["user_id"]: r["est"] for r in pred.knn_means(train, test).collect()}
    assert means == pytest.approx({"x": mean, "u1": 2.0 + (4.0 - 3.0), "u3": mean})
    slope = {r["user_id"]: r["est"] for r in pred.slope_one(train, test).collect()}
    # C against A from u2: 4 - 2; nobody rated B and C.
    assert slope == pytest.approx({"x": mean, "u1": 2.0 + 2.0, "u3": mean})



def test_best_trial_and_invalid_order(spark):
    sums = spark.createDataFrame(
        [(f"u{u}", f"p{i}", 0.1 * i, 0.2 * u, 0.3 * i, 0.1) for u in range(6) for i in range(4)],
        PAIR + ", s1 double, s2 double, s3 double, s4 double",
    )
    truth = spark.createDataFrame([(f"u{u}", "p3") for u in range(6)], PAIR)
    users = spark.createDataFrame([("u0",), ("u1",)], "user_id string")
    trials = [{"w3": 0.6, "r2": 1.0, "r4": 0.5, "r1": 0.5}, {"w3": 0.6, "r2": 0.5, "r4": 0.5, "r1": 0.5}]
    sweep = wt.weight_sweep(sums, truth, users, trials, top_n=1)
    got = {r["weight_id"]: r["f1"] for r in sweep.collect()}
    assert got == {0: -1.0, 1: 1.0}
    assert wt.best_weights(sweep) == pytest.approx((0.075, 0.3, 0.6, 0.15))


def test_a_sweep_without_a_valid_trial(spark):
    sums = spark.createDataFrame([("u0", "p", 0.1, 0.2, 0.3, 0.1)], PAIR + ", s1 double, s2 double, s3 double, s4 double")
    users = spark.createDataFrame([("u1",)], "user_id string")
    trials = [{"w3": 0.6, "r2": 1.0, "r4": 0.5, "r1": 0.5}]
    sweep = wt.weight_sweep(sums, sums.select("user_id", "product_id"), users, trials)
    assert [r.f1 for r in sweep.collect()] == [-1.0]


@pytest.mark.parametrize(("blocks", "k"), [(2, 3), (7, 1), (512, 4)])
def test_rating_neighbors_in_blocks(spark, blocks, k):
    import random

    r = random.Random(blocks)
    rows = [(f"u{u}", f"p{i}", r.randrange(1, 6) / 2) for u in range(20) for i in range(15) if r.random() < 0.4]
    r.shuffle(rows)
    train, test = rows[30:], rows[:30]
    got = {}
    near = pred.rating_neighbors(ratings(spark, train), ratings(spark, test), k, blocks)
    for n in near.collect():
        got.setdefault((n["user_id"], n["product_id"]), set()).add((n["other"], round(n["sim"], 6), n["score"]))
    by_user = {}
    for u, i, v in train:
        by_user.setdefault(u, {})[i] = v
    for u, i, _ in test:
        found = []
        for v, theirs in by_user.items():
            common = set(by_user.get(u, {})) & set(theirs)
            if v != u and i in theirs and common:
                msd = sum((by_user[u][c] - theirs[c]) ** 2 for c in common) / len(common)
                found.append((-round(1 / (msd + 1), 6), v, theirs[i]))
        want = {(v, -s, score) for s, v, score in sorted(found)[:k]}
        assert got.get((u, i), set()) == want
