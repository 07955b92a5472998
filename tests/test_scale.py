"""What must not grow with the square of the input, or be worked out twice."""

from shelfwise.operators import meet
from shelfwise.operators import predictors as pred

PAIR = "user_id string, product_id string"


def sent(monkeypatch, module):
    """Copies of the data that each call of ``meet`` sends."""
    copies = []

    def spy(asked, data, groups, *rest):
        copies.append(groups)
        return meet.meet(asked, data, groups, *rest)

    monkeypatch.setattr(module, "meet", spy)
    return copies


def test_rating_neighbors_send_a_bounded_number_of_copies(spark, monkeypatch):
    from shelfwise.operators import raters

    copies = sent(monkeypatch, raters)
    rows = [(f"u{u:03d}", f"p{i}", float((u * 7 + i * 3) % 5)) for u in range(150) for i in range(6) if (u + i) % 3]
    train = spark.createDataFrame([r for r in rows if r[1] != "p0"], PAIR + ", score double")
    more = spark.createDataFrame([r for r in rows if r[1] == "p0" and r[0] > "u075"], PAIR + ", score double")
    test = spark.createDataFrame([r for r in rows if r[1] == "p0" and r[0] <= "u075"], PAIR + ", score double")
    train = train.union(more)
    narrow = sorted(map(tuple, pred.rating_neighbors(train, test, 5, 1).collect()))
    wide = sorted(map(tuple, pred.rating_neighbors(train, test, 5, 512).collect()))
    assert narrow == wide and len(narrow) == 5 * test.count()
    assert copies == [meet.GROUPS, 1]


def test_nearest_neighbours_send_a_bounded_number_of_copies(spark, monkeypatch):
    import numpy as np

    from shelfwise.operators import knn

    copies = sent(monkeypatch, knn)
    r = np.random.default_rng(5)
    dense = [(f"d{i:03d}", [], [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(r.normal(size=(200, 8)))]
    sparse = []
    for i in range(200):
        at, v = np.sort(r.choice(40, 3, replace=False)), r.random(3) + 0.1
        sparse.append((f"s{i:03d}", [int(x) for x in at], [float(x) for x in v / np.linalg.norm(v)]))
    for rows in (dense, sparse):
        df = spark.createDataFrame(rows, "id string, idx array<int>, val array<double>")
        few = df.where("id like '%7'")
        for asked in (df, few):
            narrow = sorted(map(tuple, knn.knn_join(asked, df, 4, 1 if asked is df else 2).collect()))
            wide = sorted(map(tuple, knn.knn_join(asked, df, 4, 2048).collect()))
            assert narrow == wide and len(narrow) == 4 * asked.count()
    assert max(copies) == knn.groups_for(200, 200, 1000) == meet.GROUPS


def test_targets_that_share_a_name_are_answered_once(spark, monkeypatch):
    from shelfwise.operators import names

    seen = []
    spread = names.spread
    monkeypatch.setattr(names, "spread", lambda df, *keys: seen.append(df.count()) or spread(df, *keys))
    rows = [(f"{i:03d}", ("red bolt", "blue bolt", "old gear")[i % 3], "c", "b") for i in range(90)]
    details = spark.createDataFrame(rows, "product_id string, name string, category_code string, brand string")
    got = {}
    for r in names.name_similarity(details, n=4).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append(r["product_id"])
    assert seen == [6, 6]
    for i, (product, name, _, _) in enumerate(rows):
        assert got[product] == [r[0] for r in rows if r[1] == name and r[0] != product][:4], i
    # A target in another's list of exclusions, and in its own.
    asked = [("000", ["000", "003"], 2), ("003", ["000"], 2), ("006", [], 1), ("009", ["003"], 2)]
    targets = spark.createDataFrame(asked, "target string, excluded array<string>, needed int")
    got = {}
    for r in names.similar_names(targets, details).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append(r["product_id"])
    assert got == {"000": ["006", "009"], "003": ["006", "009"], "006": ["000"], "009": ["000", "006"]}


def counted(df, column):
    """``df`` with an accumulator of how often its rows are worked out."""
    from pyspark.sql import functions as F

    seen = df.sparkSession.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(same, "string").asNondeterministic()(column)), seen


def test_events_are_parsed_once_for_encoded_features(spark, sf):
    from checks import fixtures
    from shelfwise.operators import features as ft

    raw = fixtures.behaviors(spark, sf)
    events, seen = counted(raw, "brand")
    assert ft.feature_pipeline(events).count() > 0
    assert seen.value == raw.count()


def test_events_are_parsed_once_for_the_evaluation(spark, sf, monkeypatch):
    from checks import registry

    raw = registry.fx.behaviors(spark, sf)
    seen = []

    def behaviors(*_):
        events, number = counted(raw, "brand")
        seen.append(number)
        return events

    monkeypatch.setattr(registry.fx, "behaviors", behaviors)
    for name in ("eval_f1", "eval_topn", "rating_errors"):
        seen.clear()
        registry.QUERIES[name](spark, sf).collect()
        assert [n.value for n in seen] == [raw.count()], name
