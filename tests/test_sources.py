import pytest

from shelfwise.operators.vectors import dedupe_points, upsert_latest
from shelfwise.schemas import BEHAVIORS, CATALOG, require_columns, require_rows
from shelfwise.sources import artifacts as art
from shelfwise.sources.files import read_collection, read_csv, upsert_collection, write_collection, write_csv, write_trending


def latest(spark, names, prefix="m", default="m_default"):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    wanted = spark.createDataFrame([(prefix, default)], "prefix string, default_name string")
    return art.latest_artifact(df, wanted).first()["name"]


def test_golden_latest_artifact(spark):
    assert latest(spark, ["m_31_12_24_10_00.pkl", "m_01_02_25_09_00.pkl", "m.pkl"]) == "m_01_02_25_09_00.pkl"
    assert latest(spark, ["m.pkl", "m_old.pkl"]) == "m_old.pkl"
    assert latest(spark, []) == "m_default"
    assert latest(spark, ["m_99_99_24_10_00.pkl", "m_01_01_24_10_00.pkl"]) == "m_01_01_24_10_00.pkl"
    assert latest(spark, ["other_01_01_24_10_00.pkl"]) == "m_default"


def test_stamp_is_local_time(spark):
    assert art.stamped_name(spark, "x", "2024-12-31 20:15:00") == "x_01_01_25_03_15"


def test_models_are_written_and_found(spark, tmp_path):
    root = str(tmp_path)
    old = art.write_model(spark.range(1), root, "m", "2024-01-01 00:00:00")
    new = art.write_model(spark.range(2), root, "m", "2024-06-01 00:00:00")
    art.announce(spark, root, {"m": new})
    art.announce(spark, root, {"m": old})
    assert art.read_latest(spark, root, "m").count() == 2


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'ring, "big"', "c", "T", "b", 2.5, None)]
    write_csv(spark.createDataFrame(rows * 3, CATALOG), str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), CATALOG)
    assert back.count() == 3 and tuple(back.first()) == rows[0]
    assert read_csv(spark, str(tmp_path / "c"), CATALOG, nrows=2).count() == 2
    write_trending(back, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns[0] == "ProductID"


def test_collection_drops_repeated_points_and_merges_payloads(spark, tmp_path):
    path = str(tmp_path / "points")
    a = spark.createDataFrame([("1", "A"), ("2", "B")], "point_id string, product_id string")
    b = spark.createDataFrame(
        [("2", "B", 4.0, [1.0]), ("3", "C", 5.0, [2.0])],
        "point_id string, product_id string, price double, embedding array<double>",
    )
    write_collection(a, path + "/part=1")
    write_collection(b, path + "/part=2")
    got = read_collection(spark, path)
    assert "embedding" not in got.columns and "price" in got.columns
    assert got.count() == 3
    merged = dedupe_points([a, b], ["product_id"])
    assert sorted(r["point_id"] for r in merged.collect()) == ["1", "2", "3"]


def test_upsert_repeats_without_effect(spark):
    schema = "product_id string, version bigint, price string"
    stored = spark.createDataFrame([("a", 1, "2.5"), ("b", 1, None)], schema)
    arriving = spark.createDataFrame([("a", 2, "3"), ("c", 1, "x")], schema)
    once = upsert_latest(stored, arriving)
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("a", 2, 3.0), ("b", 1, 0.0), ("c", 1, 0.0)]
    again = upsert_latest(once, arriving.withColumn("price", arriving["price"].try_cast("double")))
    assert sorted(map(tuple, again.collect())) == rows


def test_validation(spark):
    with pytest.raises(ValueError, match="brand"):
        require_columns(spark.createDataFrame([("a",)], "name string"), ["name", "brand"])
    with pytest.raises(ValueError, match="empty"):
        require_rows(spark.createDataFrame([], BEHAVIORS))


def test_two_models_of_one_minute_stay_apart(spark, tmp_path):
    root, at = str(tmp_path), "2024-06-01 00:00:00"
    old = art.write_model(spark.range(1), root, "m", at)
    reader = art.read_model(spark, root, old)
    art.announce(spark, root, {"m": old})
    new = art.write_model(spark.range(2), root, "m", at)
    art.announce(spark, root, {"m": new})
    assert old != new and reader.count() == 1
    assert art.read_latest(spark, root, "m").count() == 2


def test_prefixes_are_plain_text_and_an_empty_root_falls_back(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/a.b")
    assert art.read_latest(spark, root, "a.b").count() == 3
    names = spark.createDataFrame([("axb_01_01_24_00_00",), ("a.b_01_01_23_00_00",)], "name string")
    wanted = spark.createDataFrame([("a.b", "none")], "prefix string, default_name string")
    assert art.latest_artifact(names, wanted, "$").first()["name"] == "a.b_01_01_23_00_00"


def test_upserts_are_staged_versions(spark, tmp_path):
    root = str(tmp_path)
    schema = "product_id string, version int, price string, payload map<string,string>"
    first = spark.createDataFrame([("a", 1, None, {"x": "1"}), ("b", 1, "2", {})], schema)
    upsert_collection(root, first)
    before = art.read_latest(spark, root, "vectors")
    second = spark.createDataFrame([("a", 2, "5", {"x": "2"}), ("b", 0, "9", {}), ("c", 1, "7", None)], schema)
    for _ in range(2):  # a repeated upsert changes nothing
        upsert_collection(root, second)
        rows = art.read_latest(spark, root, "vectors").collect()
        assert {(r.product_id, r.version, r.price) for r in rows} == {("a", 2, 5.0), ("b", 1, 2.0), ("c", 1, 7.0)}
    assert {r.version for r in before.collect()} == {1}
