"""Tables with a row per user or product are not gathered on the driver."""

from shelfwise.operators import factors as fac
from shelfwise.operators.baselines import fit_baselines, predict_baselines

RATING = "user_id string, product_id string, score double"


def test_a_grid_search_broadcasts_no_table_that_grows(spark, monkeypatch):
    rows = [(f"u{u}", f"p{p}", float((u * 3 + p * 5) % 7)) for u in range(8) for p in range(6) if (u + p) % 4]
    data = spark.createDataFrame(rows, RATING)
    plans, cut = [], fac.cut

    def spy(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, **options)

    monkeypatch.setattr("shelfwise.operators.baselines.cut", spy)
    base = fit_baselines(data, epochs=6)
    assert any("SortMergeJoin" in p for p in plans)
    monkeypatch.setattr(fac, "cut", spy)
    rest = fac.leftover(data, base)
    model = fac.fit_factors(data, rest=rest, rank=1, maxIter=1)
    for df in (predict_baselines(base, data), fac.predict_factors(model, data), fac.nmf_scores(data, data, rank=1, maxIter=1)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    # dense numbers broadcast the offsets of at most 256 ranges, which is a fixed size
    assert not [p for p in plans if "BroadcastExchange" in p and "__range" not in p]
