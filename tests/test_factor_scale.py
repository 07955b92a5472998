"""What fits share is worked out once."""

from shelfwise.operators import factors as fac
from shelfwise.operators.baselines import fit_baselines, predict_baselines
from shelfwise.operators.predictors import coclustering

RATING = "user_id string, product_id string, score double"


def ratings(spark):
    rows = [(f"u{u}", f"p{p}", float((u * 3 + p * 5) % 7)) for u in range(8) for p in range(6) if (u + p) % 4]
    return spark.createDataFrame(rows, RATING)


def test_cluster_means_come_without_another_pass_over_the_ratings(spark, monkeypatch):
    data = ratings(spark)
    plain, joined = type(data).collect, []

    def collect(self):
        joined.append("Join" in self._jdf.queryExecution().optimizedPlan().toString())
        return plain(self)

    monkeypatch.setattr(type(data), "collect", collect)
    coclustering(data, data, epochs=1)
    assert joined and not any(joined)


def test_what_the_offsets_leave_is_written_once(spark):
    data = ratings(spark)
    base = fit_baselines(data, epochs=1)
    rest = fac.leftover(data, base)
    assert "Join" not in rest.coded._jdf.queryExecution().optimizedPlan().toString()
    found = rest.coded.join(rest.users, "u").join(rest.items, "i").collect()
    want = {(r["user_id"], r["product_id"]): r["score"] - r["raw"] for r in predict_baselines(base, data).collect()}
    assert {(r["user_id"], r["product_id"]): round(r["left"], 9) for r in found} == {
        k: round(v, 9) for k, v in want.items()
    }


def test_settings_share_the_work_of_a_fold(spark, monkeypatch):
    plain, numbered = fac._numbered, []
    monkeypatch.setattr(fac, "_numbered", lambda df: numbered.append(1) or plain(df))
    grid = [{"rank": 1, "maxIter": 1}, {"rank": 2, "maxIter": 1}]
    assert fac.grid_search(ratings(spark), grid, folds=2, epochs=1).count() == 2
    assert len(numbered) == 2
