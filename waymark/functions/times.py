"""Times of day that may pass midnight, and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(c: Column) -> Column:
    """Seconds of an HH:MM:SS text, whose hours may exceed 23; null for anything else."""
    parts = F.split(F.trim(c.cast("string")), ":")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("bigint")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def clock(c: Column) -> Column:
    """HH:MM:SS of seconds, hours beyond 23 as they are; null as empty text."""
    s = c.cast("bigint")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    hours = F.floor(s / 3600).cast("bigint")
    return F.when(s.isNull(), "").otherwise(F.concat_ws(":", two(hours), two(F.floor(s % 3600 / 60).cast("bigint")), two(s % 60)))


def valid_on(begin: Column, end: Column, day: Column, end_inclusive: bool = False) -> Column:
    """Whether an interval holds ``day``: it has begun, and it hasn't an end, or one behind (or on) that day."""
    open_end = end.isNull() | (F.trim(end.cast("string")) == "")
    later = end >= day if end_inclusive else end > day
    return F.coalesce((begin <= day) & (open_end | F.coalesce(later, F.lit(False))), F.lit(False))


def weekday_flag(day: Column, *flags: Column) -> Column:
    """The flag (Monday first) of the weekday of ``day``."""
    return F.element_at(F.array(*flags), F.weekday(day) + 1)
