"""Time arithmetic in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column | str) -> Column:
    return F.timestamp_micros(F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def days(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Complete 24-hour days from start to end, rounded down."""
    return F.floor((micros(end) - micros(start)) / float(DAY))


def days_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / float(DAY)


def ceil_div(a: Column, b: int) -> Column:
    """Ceiling of an integer division, without going through floating point."""
    d = F.lit(b)
    return F.when(a > 0, F.call_function("div", a + (b - 1), d)).otherwise(F.call_function("div", a, d))


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))
