"""Column expressions used across operators. All of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token pattern (two or more word characters, accented letters included),
# time formats and the time zone of model names.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MESSAGE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"
ARTIFACT_TIME_FORMAT = "dd_MM_yy_HH_mm"
ARTIFACT_ZONE = "Asia/Ho_Chi_Minh"


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded value without negative zero."""
    return F.round(c, places) + F.lit(0.0)


def is_present(name: str, dtype: T.DataType) -> Column:
    """True for a value that is neither missing nor zero: 0 and '0' count as missing."""
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c) & (c != 0)
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != 0)
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & (c != "0")
    return c.isNotNull()


def draw_key(seed: int | str, *parts: Column) -> Column:
    """Repeatable random order: md5 of the seed and the row's key, the same in every engine."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), p.cast("string")]
    return F.md5(F.concat(*pieces))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def first_of(order: list[Column], fields: list[str]) -> Column:
    """Aggregate: the fields of the first row by ``order``.

    A min over a struct combines on the map side, so a hot key costs one row per task.
    """
    keyed = F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("row")
    )
    return F.min(keyed).getField("row")


def message_time(value: Column) -> Column:
    """Event time inside a JSON message; null when absent or unreadable."""
    parsed = F.from_json(value, "event_time STRING", {"mode": "PERMISSIVE"})
    return F.try_to_timestamp(parsed["event_time"], F.lit(MESSAGE_TIME_FORMAT))


def artifact_stamp(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ARTIFACT_ZONE), ARTIFACT_TIME_FORMAT)
