"""Filter, retrain, serve and sticky clusters, driven by files and restarted from checkpoints."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from shelfwise.operators.features import clean_events
from shelfwise.plans import train
from shelfwise.schemas import RETRAIN_RECORD
from shelfwise.sources.kafka import as_messages, read_record_files
from shelfwise.storage import checkpoint_dir
from shelfwise.streaming import requests as serving
from shelfwise.streaming.retrain import accepted, retrain_on
from shelfwise.streaming.sticky import sticky_clusters

NOW = "2024-05-01 12:00:00"


def records(spark, values, start=0):
    rows = [
        ("retrain", 0, start + i, None, None if v is None else bytearray(v.encode()))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, RETRAIN_RECORD)


def message(time):
    return f'{{"event_time": "{time} UTC", "event_type": "view"}}'


def test_filter_keeps_recent_and_unreadable_records(spark):
    values = [
        None,
        message("2024-05-01 11:00:00"),  # exactly one hour old
        message("2024-05-01 10:59:59"),
        "{bad",
        '{"event_type": "view"}',
        '{"event_time": "yesterday"}',
        "",
    ]
    kept = accepted(records(spark, values), F.lit(NOW).cast("timestamp"))
    assert sorted(r["offset"] for r in kept.collect()) == [1, 3, 4, 5, 6]


def test_retrain_once_per_batch_and_goes_on_after_restart(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    calls = []

    def run():
        query = retrain_on(
            read_record_files(spark, source),
            lambda: calls.append(1),
            checkpoint,
            F.lit(NOW).cast("timestamp"),
            once=True,
        )
        query.awaitTermination(120)

    fresh = message("2024-05-01 11:30:00")
    records(spark, [fresh, fresh, None]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert len(calls) == 1
    run()  # nothing new
    assert len(calls) == 1
    records(spark, [message("2024-05-01 09:00:00")], 3).coalesce(1).write.mode("append").parquet(source)
    run()  # only a record that is too old
    assert len(calls) == 1
    records(spark, [fresh], 4).coalesce(1).write.mode("append").parquet(source)
    run()
    assert len(calls) == 2


def test_messages_are_bytes(spark):
    df = as_messages(spark.createDataFrame([("models ready",), (None,)], "message string"))
    assert [r["value"] for r in df.collect()] == [bytearray(b"models ready"), None]


@pytest.fixture(scope="module")
def trained(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    names = train.train_all(fx.behaviors(spark, sf), fx.catalog(spark, sf), root, at="2024-03-01 02:30:00")
    return root, names


def test_train_writes_stamped_models_and_announces_them(spark, trained):
    root, names = trained
    # 02:30 UTC is 09:30 in the zone of model names.
    assert names[train.CONTENT].startswith("content_base_01_03_24_09_30-")
    assert train.current_models(spark, root) == names
    model = train.read_collaborative(spark, root, names[train.COLLABORATIVE])
    assert model.users.count() > 0 and model.items.count() > 0


def test_requests_are_answered_from_the_stream(spark, sf, trained, tmp_path):
    root, _ = trained
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = clean_events(fx.behaviors(spark, sf))
    known = events.select("user_id", "product_id").orderBy("user_id", "event_id").first()
    rows = [
        ("content", "r1", None, "7", None, None),
        ("content", "r2", None, "no such product", None, None),
        ("session", "r3", known["user_id"], known["product_id"], None, None),
        ("session", "r4", "nobody", known["product_id"], None, None),
        ("anonymous", "r5", None, known["product_id"], None, None),
        ("cart", "r6", None, None, [known["product_id"]], 3),
    ]
    spark.createDataFrame(rows, serving.REQUEST).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(serving.REQUEST).parquet(source)

    def sink(df, number):
        df.write.mode("overwrite").parquet(f"{out}/{number}")

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    query = serving.serve(stream, root, sink, str(tmp_path / "cp"), once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    got = spark.read.parquet(f"{out}/0").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")
    )
    counts = {r["request_id"]: (r["n"], r["last"]) for r in got.collect()}
    assert counts["r1"] == (10, 10)
    assert counts["r2"] == (1, None)
    lost = spark.read.parquet(f"{out}/0").where("request_id = 'r2'").first()
    assert (lost.status, lost.product_id) == ("not found", None)
    assert counts["r3"] == (10, 10)
    assert 0 < counts["r4"][0] <= 10 and 0 < counts["r5"][0]
    assert 1 <= counts["r6"][0] <= 3
    left = {x for x in set(os.listdir(folder)) - before if x.startswith("cut-")}
    assert not left


def test_sticky_cluster_stays_while_the_product_is_inside(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    clusters = spark.createDataFrame(
        [("A", "B"), ("A", "C"), ("B", "A"), ("C", "A"), ("D", None), ("E", "B")],
        "target string, candidate string",
    )
    schema = "user_id string, at timestamp, product_id string"
    source = str(tmp_path / "in")

    def put(rows):
        rows = [(u, dt.datetime(2024, 1, 1, 0, m), p) for u, m, p in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            sticky_clusters(stream, clusters)
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp"))
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(180)
        assert query.exception() is None

    put([("u", 0, "A"), ("u", 1, "B"), ("v", 0, "B")])
    run()
    put([("u", 2, "C"), ("u", 3, "D"), ("v", 1, "A"), ("v", 2, "unknown")])
    run()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r["user_id"], r["target"]): r["cluster"] for r in out}
    assert got == {
        ("u", "A"): "A", ("u", "B"): "A", ("u", "C"): "A", ("u", "D"): "D",
        ("v", "B"): "B", ("v", "A"): "B", ("v", "unknown"): "B",
    }
