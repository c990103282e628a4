"""Clock expressions: decision time, local session clock, and a guard for ambiguous local readings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barwright.functions.numeric import col

MICROS_PER_MINUTE = 60_000_000


def micros(ts) -> Column:
    return F.unix_micros(col(ts))


def from_micros(value) -> Column:
    return F.timestamp_micros(col(value).cast("bigint"))


def plus_minutes(ts, minutes) -> Column:
    shift = col(minutes) if isinstance(minutes, (Column, str)) else F.lit(int(minutes))
    return from_micros(micros(ts) + shift.cast("bigint") * F.lit(MICROS_PER_MINUTE).cast("bigint"))


def bar_index(ts, minutes: int) -> Column:
    """Number of whole timeframes since the epoch."""
    width = minutes * MICROS_PER_MINUTE
    return F.floor(micros(ts) / F.lit(width)).cast("bigint")


def local_time(ts, zone: str) -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def minute_of_session(ts, zone: str, opening_hour: int) -> Column:
    local = local_time(ts, zone)
    return (F.hour(local) * 60 + F.minute(local) - opening_hour * 60).cast("bigint")


def local_to_utc(reading, zone: str) -> tuple[Column, Column]:
    """UTC time of a local reading and its problem: NONEXISTENT, AMBIGUOUS or NULL.

    The built-in conversion resolves both kinds silently, so a round trip is compared:
    a nonexistent reading does not come back, an ambiguous one comes back from an hour away too.
    """
    reading = col(reading)
    utc = F.to_utc_timestamp(reading, zone)
    back = F.from_utc_timestamp(utc, zone)
    hour = F.expr("interval 1 hour")
    twin = (F.from_utc_timestamp(utc + hour, zone) == reading) | (F.from_utc_timestamp(utc - hour, zone) == reading)
    problem = F.when(back != reading, F.lit("NONEXISTENT")).when(twin, F.lit("AMBIGUOUS"))
    return utc, problem
