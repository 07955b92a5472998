"""Topics as streaming tables. The connector is chosen by name, so files can stand in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import RETRAIN_RECORD


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Records from the end of the topic on; a restart goes on from the checkpoint instead."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )


def read_record_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """The same records from a folder of Parquet files."""
    return (
        spark.readStream.schema(RETRAIN_RECORD)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(path)
    )


def as_messages(df: DataFrame, text: str = "message") -> DataFrame:
    """One UTF-8 ``value`` per row, as a topic takes them."""
    return df.select(F.col(text).cast("string").cast("binary").alias("value"))


def send(df: DataFrame, servers: str, topic: str) -> None:
    """Write ``value`` rows of a batch table to a topic."""
    (
        df.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def send_stream(df: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return (
        df.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
