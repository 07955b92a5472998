import datetime as dt
import random
from collections import Counter

import pytest

from shelfwise.operators.baselines import Baselines
from shelfwise.operators.factors import Factors
from shelfwise.plans import session as ses
from shelfwise.plans.cold import anonymous_recommend, cold_recommend
from shelfwise.plans.personal import best_products, personal_recommend

EVENT = "user_session string, product_id string, event_time timestamp, event_id bigint"


def random_events(seed, n=600):
    """Sessions that last for months, so many of them cross a product's window."""
    r = random.Random(seed)
    start = dt.datetime(2023, 1, 1)
    return [
        (f"s{r.randrange(25)}", f"p{r.randrange(20)}", start + dt.timedelta(hours=r.randrange(24 * 400)), i)
        for i in range(n)
    ]


def minus_months(t, months):
    y, m = divmod(t.year * 12 + t.month - 1 - months, 12)
    for day in (t.day, 30, 29, 28):
        try:
            return t.replace(year=y, month=m + 1, day=day)
        except ValueError:
            continue


def brute(rows, target, months=3):
    times = [t for _, p, t, _ in rows if p == target]
    if not times:
        return {}
    hi = max(times)
    lo = minus_months(hi, months)
    recent = [(s, p) for s, p, t, _ in rows if lo <= t <= hi]
    holds = {s for s, p in recent if p == target}
    return Counter(p for s, p in recent if s in holds and p != target)


@pytest.mark.parametrize("chunk", [2, 64])
def test_candidates_match_row_by_row_counting(spark, chunk):
    rows = random_events(chunk)
    events = spark.createDataFrame(rows, EVENT)
    targets = [f"p{i}" for i in range(0, 20, 3)] + ["unseen"]
    asked = spark.createDataFrame([(t,) for t in targets], "product_id string")
    got = {}
    for r in ses.session_candidates(events, asked, chunk=chunk).collect():
        got.setdefault(r["target"], {})[r["product_id"]] = r["appearance_count"]
    for t in targets:
        assert got.get(t, {}) == dict(brute(rows, t))


def test_only_sessions_across_a_border_are_cut_into_slices(spark, monkeypatch):
    """Sessions of a day: of 60 a target's last one may run on, the others add their counts as a whole."""
    start, r = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [
        (f"s{d}", f"p{r.randrange(6)}", start + dt.timedelta(days=d, hours=r.randrange(24)), 0)
        for d in range(60)
        for _ in range(8)
    ]
    met = []
    sums = ses.pair_sums

    def spy(df, key, *more, **options):
        met.append((key, df.count()))
        return sums(df, key, *more, **options)

    monkeypatch.setattr(ses, "pair_sums", spy)
    events = spark.createDataFrame(rows, EVENT)
    asked = spark.createDataFrame([(f"p{i}",) for i in range(6)], "product_id string")
    got = {}
    for x in ses.session_candidates(events, asked).collect():
        got.setdefault(x["target"], {})[x["product_id"]] = x["appearance_count"]
    assert got == {f"p{i}": dict(brute(rows, f"p{i}")) for i in range(6)}
    assert met[0] == ("user_session", len({x[:2] for x in rows})) and met[1][1] <= 6 * 8


def test_lists_follow_the_tiers(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("s1", "T")] + [("s1", p) for p in "AAAABBBCCCCCDDDEF"] + [("s2", p) for p in "GHIJKLM"]
    events = spark.createDataFrame([(s, p, day, i) for i, (s, p) in enumerate(rows)], EVENT)
    b_i = {p: i / 100 for i, p in enumerate("TABCDEFGHIJKLM")}
    model = Baselines(
        ["score"], {"score": 1.0}, {"score": 0.0}, {"score": 1.2},
        spark.createDataFrame([("u", 0.1)], "user_id string, b_u double"),
        spark.createDataFrame(list(b_i.items()), "product_id string, b_i double"),
    )
    details = spark.createDataFrame([("A", "ring")], "product_id string, name string")
    asked = spark.createDataFrame([("u", "T"), ("stranger", "T"), ("u", "none")], "user_id string, product_id string")
    got = ses.session_recommend(asked, events, model, details).orderBy("rank").collect()
    # Frequent: C 5, A 4, then D and B with 3, of which D scores higher. Then by score, then fill.
    assert [r["product_id"] for r in got] == list("CADFEBMLKJ")
    assert [r["appearance_count"] for r in got] == [5, 4, 3, 1, 1, 3, None, None, None, None]
    assert {r["user_id"] for r in got} == {"u"} and {r["target"] for r in got} == {"T"}
    assert got[6]["predicted_score"] == pytest.approx(1.2)  # clipped
    assert got[1]["name"] == "ring" and got[0]["name"] is None


def test_cold_lists_order_and_fill(spark):
    clusters = spark.createDataFrame(
        [("T", "top", i, f"t{i}") for i in range(1, 4)]
        + [("T", "others", i, f"o{i}") for i in range(1, 4)]
        + [("lonely", None, None, None)],
        "target string, bucket string, rank int, candidate string",
    )
    names = [("T", "red ring"), ("a", "red ring"), ("b", "blue ring"), ("t1", "red ring"), ("z", "gear")]
    names += [("lonely", "gear")]
    details = spark.createDataFrame(
        [(p, n, "c", "b") for p, n in names],
        "product_id string, name string, category_code string, brand string",
    )
    asked = spark.createDataFrame([("T",), ("t2",), ("lonely",), ("nothing",)], "product_id string")

    def lists(df):
        out = {}
        for r in df.orderBy("target", "rank").collect():
            out.setdefault(r["target"], []).append((r["source"], r["product_id"]))
        return out

    first = lists(cold_recommend(asked, clusters, details))
    assert [s for s, _ in first["T"]] == ["top"] * 3 + ["others"] * 2 + ["similar"] * 4
    assert [p for s, p in first["T"] if s == "similar"] == ["a", "b", "lonely", "z"]
    # A product inside another's cluster is answered from it, without itself; it has no details.
    assert [s for s, _ in first["t2"]] == ["top"] * 2 + ["others"] * 2
    assert [s for s, _ in first["lonely"]] == ["similar"] * 5
    assert "nothing" not in first
    second = lists(anonymous_recommend(asked, clusters, details))
    assert [s for s, _ in second["T"]] == ["others"] * 2 + ["top"] * 3 + ["similar"] * 4
    short = lists(cold_recommend(asked, clusters, details, size=2))
    assert [s for s, _ in short["T"]] == ["top", "top"]


def test_two_users_get_their_own_orders(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("s1", p) for p in "TAB"] + [("s2", p) for p in "CDEFGH"]
    events = spark.createDataFrame([(s, p, day, i) for i, (s, p) in enumerate(rows)], EVENT)
    names = sorted({p for _, p in rows})
    base = Baselines(
        ["score"], {"score": 1.0}, {"score": 0.0}, {"score": 2.0},
        spark.createDataFrame([("u", 0.0), ("w", 0.1)], "user_id string, b_u double"),
        spark.createDataFrame([(p, 0.0) for p in names], "product_id string, b_i double"),
    )
    model = Factors(
        base,
        spark.createDataFrame([("u", [1.0]), ("w", [-1.0])], "user_id string, p array<double>"),
        spark.createDataFrame([(p, [i / 16]) for i, p in enumerate(names)], "product_id string, q array<double>"),
    )
    asked = spark.createDataFrame([("u", "T"), ("w", "T"), ("x", "T"), ("u", "Z")], "user_id string, product_id string")
    details = events.select("product_id").distinct()
    found = personal_recommend(asked, events, model, details, size=5).orderBy("user_id", "rank").collect()
    lists = {}
    for r in found:
        lists.setdefault((r.user_id, r.target), []).append(r.product_id)
    assert lists == {("u", "T"): list("BAHGF"), ("w", "T"): list("ABCDE")}
    assert found[0].predicted_score == pytest.approx(1.0 + 1 / 16)


@pytest.mark.parametrize(("users", "items"), [(1024, 16_384), (3, 4)])
def test_best_products_in_blocks(spark, monkeypatch, users, items):
    from shelfwise.plans import personal

    monkeypatch.setattr(personal, "USER_BLOCK", users)
    monkeypatch.setattr(personal, "ITEM_BLOCK", items)
    r = random.Random(4)
    p = {f"u{i}": [r.randint(-8, 8) / 8 for _ in range(3)] for i in range(20)}
    q = {f"i{i}": (r.randint(-4, 4) / 8, [r.randint(-8, 8) / 8 for _ in range(3)]) for i in range(30)}
    left = spark.createDataFrame([*p.items(), ("none", [])], "user_id string, p array<double>")
    right = spark.createDataFrame([(i, b, v) for i, (b, v) in q.items()], "product_id string, b_i double, q array<double>")
    got = {}
    for x in best_products(left, right, 4).collect():
        got.setdefault(x.user_id, set()).add(x.product_id)
    p["none"] = [0.0] * 3
    for u, own in p.items():
        order = sorted(q, key=lambda i: (-q[i][0] - sum(a * b for a, b in zip(own, q[i][1], strict=True)), i))
        assert got[u] == set(order[:4])


def test_most_users_are_done_after_a_few_ranges(spark, monkeypatch):
    """50,000 products whose vectors get shorter: a block meets few users behind the first ranges."""
    from pyspark.sql import functions as F

    from shelfwise.plans import personal

    met = []
    search = personal._best_of_range

    def watched(users, items, *more):
        met.append((users.count(), items.count()))
        return search(users, items, *more)

    monkeypatch.setattr(personal, "_best_of_range", watched)
    n = 50_000
    turn = (F.col("id") * 0.7).alias("a")
    items = spark.range(n).select("id", turn, (100 / (F.col("id") + 1) ** 0.5).alias("r"))
    items = items.select(
        F.format_string("i%05d", "id").alias("product_id"),
        F.lit(0.0).alias("b_i"),
        F.array(F.col("r") * F.cos("a"), F.col("r") * F.sin("a")).alias("q"),
    )
    users = spark.range(40).select(
        F.concat(F.lit("u"), "id").alias("user_id"), F.array(F.cos(F.col("id")), F.sin(F.col("id"))).alias("p")
    )
    users = users.unionByName(spark.createDataFrame([("none", [])], "user_id string, p array<double>"))
    got = {}
    for x in best_products(users, items, 5, item_block=512).collect():
        got.setdefault(x.user_id, set()).add(x.product_id)
    assert sum(u * i for u, i in met) < 0.1 * 41 * n and met[0][1] <= 600
    rows = [(x.product_id, x.q) for x in items.collect()]
    for x in users.collect():
        p = x.p or [0.0, 0.0]
        order = sorted(rows, key=lambda v: (-round(p[0] * v[1][0] + p[1] * v[1][1], 6), v[0]))
        assert got[x.user_id] == {i for i, _ in order[:5]}


def test_long_products_do_not_keep_short_users_searching(spark, monkeypatch):
    """Vectors of products fall from 0.25, those of users are a tenth: the offset is not part of that."""
    from pyspark.sql import functions as F

    from shelfwise.plans import personal

    met = []
    search = personal._best_of_range

    def watched(users, items, *more):
        met.append(users.count() * items.count())
        return search(users, items, *more)

    monkeypatch.setattr(personal, "_best_of_range", watched)
    n = 4_000
    turn = (F.col("id") * 0.7).alias("a")
    items = spark.range(n).select("id", turn, (0.25 / (F.col("id") + 1) ** 0.3).alias("r")).select(
        F.format_string("i%05d", "id").alias("product_id"),
        F.lit(0.0).alias("b_i"),
        F.array(F.col("r") * F.cos("a"), F.col("r") * F.sin("a")).alias("q"),
    )
    own = F.array(0.1 * F.cos(F.col("id")), 0.1 * F.sin(F.col("id"))).alias("p")
    users = spark.range(30).select(F.concat(F.lit("u"), "id").alias("user_id"), own)
    got = {}
    for x in best_products(users, items, 5, user_block=8, item_block=128).collect():
        got.setdefault(x.user_id, {})[x.product_id] = x.value
    assert sum(met) < 0.3 * 30 * n
    rows = [(x.product_id, x.q) for x in items.collect()]
    for x in users.collect():
        values = [(-round(x.p[0] * q[0] + x.p[1] * q[1], 6), i) for i, q in rows]
        assert got[x.user_id] == pytest.approx({i: -v for v, i in sorted(values)[:5]}, abs=1e-9)


def test_equal_values_go_by_the_smaller_id_across_ranges(spark):
    rows = [(f"i{i:03d}", 0.0, [1.0 if i % 3 else 0.5, i / 1e9]) for i in range(200, 0, -1)]
    items = spark.createDataFrame(rows, "product_id string, b_i double, q array<double>")
    users = spark.createDataFrame([("u", [1.0, 0.0]), ("w", [0.0, 0.0])], "user_id string, p array<double>")
    got = {}
    for x in best_products(users, items, 4, item_block=16).collect():
        got.setdefault(x.user_id, set()).add((x.product_id, x.value))
    assert got["u"] == {(i, 1.0) for i in ("i001", "i002", "i004", "i005")}
    assert got["w"] == {(i, 0.0) for i in ("i001", "i002", "i003", "i004")}
