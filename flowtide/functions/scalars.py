"""Scalar column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of a dotted quad (octets aren't range-checked) and the private ranges of RFC 1918.
IPV4_SHAPE = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
PRIVATE_IPV4 = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)"
#: One text timestamp: date, T or blank, time, fraction of up to nine digits, zone.
TEXT_TIME = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s?(Z|UTC|[+-]\d{2}(?::?\d{2})?)?$"


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in seconds; works for both timestamp types, whatever the session's zone."""
    return (end - start).cast("interval day to second").cast("interval second").cast("decimal(20,6)").cast("double")


def duration(start: Column, end: Column) -> Column:
    """Seconds of a flow, null where it would end before it starts."""
    return F.when(end >= start, seconds_between(start, end))


def is_private(ip: Column, pattern: str = PRIVATE_IPV4) -> Column:
    """Whether a dotted quad is private; null for anything else. The pattern is a parameter."""
    return F.when(ip.rlike(IPV4_SHAPE), ip.rlike(pattern))


def non_negative(value: Column) -> Column:
    """The value as a double, negative ones null."""
    number = value.cast("double")
    return F.when(number >= 0, number)


def finite(value: Column) -> Column:
    """The value, with NaN and infinities null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def heavy_tailed(value: Column) -> Column:
    """ln(1 + x) with negative x as 0."""
    number = finite(value.cast("double"))
    return F.when(number.isNotNull(), F.log1p(F.greatest(number, F.lit(0.0))))


def first_match(arms: Sequence[tuple[Column, object]], default: object) -> Column:
    """The value of the first arm that holds."""
    out = None
    for condition, value in arms:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def instant(value: datetime, ntz: bool) -> Column:
    """A literal of a UTC instant, of the type that the compared column has."""
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz") if ntz else F.lit(text + "+00:00").cast("timestamp")


def text_time(raw: Column) -> tuple[Column, Column]:
    """(instant, status) of a text: status null for null, else ``invalid``, ``no_offset`` (UTC assumed) or ``ok``."""
    text = F.trim(raw)
    zone = F.regexp_extract(text, TEXT_TIME, 3)
    hours = F.regexp_extract(zone, r"^[+-](\d{2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    offset = F.when(zone.isin("", "Z", "UTC"), F.lit("+00:00")).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0")))
    near = zone.isin("", "Z", "UTC") | ((hours * 60 + minutes <= 14 * 60) & (minutes < 60))
    clock = F.regexp_extract(text, TEXT_TIME, 2)
    joined = F.concat(F.regexp_extract(text, TEXT_TIME, 1), F.lit(" "), clock, F.when(F.length(clock) == 5, F.lit(":00")).otherwise(F.lit("")), offset)
    value = F.when(text.rlike(TEXT_TIME) & near, joined.try_cast("timestamp"))
    status = F.when(raw.isNull(), F.lit(None).cast("string")).when(value.isNull(), "invalid").when(zone == "", "no_offset").otherwise("ok")
    return value, status


def epoch_time(raw: Column, unit: str) -> Column:
    """The instant of a whole-number epoch in s, ms, us or ns (division truncates toward zero)."""
    value = raw.cast("long")
    if unit == "ns":
        return F.timestamp_micros(F.call_function("div", value, F.lit(1000)))
    return {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit](value)

