"""Retrain on events of a stream: filter the records, train once per batch, announce."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import message_time
from ..storage import working_tables

# Fixed value: records older than this many seconds are skipped.
MAX_AGE = 3600


def accepted(records: DataFrame, now: Column | None = None, max_age: int = MAX_AGE) -> DataFrame:
    """Records with a value whose event time is not too old; a record without a readable event
    time passes. ``now`` is the batch's time unless given. No state, hence no watermark."""
    now = F.current_timestamp() if now is None else now
    text = F.col("value").cast("string")
    df = records.where(F.col("value").isNotNull()).withColumns(
        {"message": text, "event_time": message_time(text)}
    )
    age = (F.unix_micros(now) - F.unix_micros("event_time")) / 1e6
    return df.where(F.col("event_time").isNull() | (age <= max_age))


def retrain_on(
    records: DataFrame,
    train: Callable[[], object],
    checkpoint: str,
    now: Column | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Run ``train`` once for every batch that holds an accepted record.

    The checkpoint keeps the position, so a crash repeats the batch instead of losing it; models
    are written under new names, so a repeated batch only adds newer ones. Working tables are
    deleted after each batch.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not accepted(df, now).isEmpty():
            with working_tables(df.sparkSession):
                train()

    writer = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
