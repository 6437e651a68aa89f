"""Time arithmetic as Column expressions. Dates are TIMESTAMP_NTZ read as UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_S = 86_400


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_s(c: str | Column) -> Column:
    return F.unix_seconds(col(c).cast("timestamp"))


def epoch_us(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def from_epoch_s(c: str | Column) -> Column:
    return F.timestamp_seconds(col(c)).cast("timestamp_ntz")


def from_epoch_us(c: str | Column) -> Column:
    return F.timestamp_micros(col(c)).cast("timestamp_ntz")


def plus_seconds(c: str | Column, seconds: int | str | Column) -> Column:
    """`c` moved by a number of seconds (literal or column)."""
    s = F.lit(seconds) if isinstance(seconds, int) else col(seconds)
    return from_epoch_us(epoch_us(c) + s.cast("long") * F.lit(1_000_000))


def minutes_between(later: str | Column, earlier: str | Column) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(60_000_000.0)
