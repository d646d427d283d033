"""Durations and event time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def duration_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two timestamps, NULL when one is missing."""
    return F.timestamp_diff("MICROSECOND", started, finished) / F.lit(1e6)


def format_duration(seconds: Column) -> Column:
    """``-``, ``6.5s`` below a minute, ``2m 5s`` above."""
    tenths = F.floor(seconds * 10 + 0.5).cast("bigint")
    whole = F.floor(seconds).cast("bigint")
    short = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")
    )
    long = F.concat(
        F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")
    )
    return F.when(seconds.isNull(), "-").when(seconds < 60, short).otherwise(long)


def as_event_time(ntz: Column) -> Column:
    """Naive UTC time as an instant; watermarks need one, whatever the session zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ntz))


def as_naive_utc(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))
