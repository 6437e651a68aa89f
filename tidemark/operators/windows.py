"""Frames over consecutive bars. Each function takes the frame's base window `w` of a `framed` block."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(value: Column, w: WindowSpec, first: int, last: int) -> Column:
    """True where the frame has all its rows."""
    return F.count(value).over(w.rowsBetween(first, last)) == last - first + 1


def frame_max(c: str | Column, w: WindowSpec, first: int, last: int) -> Column:
    return F.max(_c(c)).over(w.rowsBetween(first, last))


def frame_min(c: str | Column, w: WindowSpec, first: int, last: int) -> Column:
    return F.min(_c(c)).over(w.rowsBetween(first, last))


def frame_argmax(c: str | Column, w: WindowSpec, first: int, last: int, bar: str = "bar") -> Column:
    """Offset from the frame's start to its first maximum."""
    best = F.max(F.struct(_c(c), -F.col(bar))).over(w.rowsBetween(first, last))
    return -best["col2"] - F.col(bar) - first


def frame_argmin(c: str | Column, w: WindowSpec, first: int, last: int, bar: str = "bar") -> Column:
    """Offset from the frame's start to its first minimum."""
    best = F.min(F.struct(_c(c), F.col(bar))).over(w.rowsBetween(first, last))
    return best[bar] - F.col(bar) - first


def frame_array(c: str | Column, w: WindowSpec, first: int, last: int) -> Column:
    """The frame's values in bar order; for frames of known length only."""
    return F.collect_list(_c(c)).over(w.rowsBetween(first, last))


def tops_mean(c: str | Column, w: WindowSpec, window: int, percent: float, largest: bool) -> Column:
    """Mean of the smallest or largest `percent` of the last `window` values, at least one, NULL until full."""
    k = max(-int(-(window * percent) // 1), 1)
    values = F.sort_array(frame_array(c, w, -(window - 1), 0), asc=not largest)
    total = F.aggregate(F.slice(values, 1, k), F.lit(0.0), lambda a, x: a + x)
    return F.when(full(_c(c), w, -(window - 1), 0), total / k)


def slope(c: str | Column, w: WindowSpec, length: int, bar: str = "bar") -> Column:
    """Slope of the straight line through the last `length` values."""
    frame = w.rowsBetween(-(length - 1), 0)
    return F.when(full(_c(c), w, -(length - 1), 0), F.regr_slope(_c(c), F.col(bar).cast("double")).over(frame))


def mid(w: WindowSpec, length: int) -> Column:
    """Middle of the highest high and the lowest low of the last `length` bars."""
    value = (frame_max("high", w, -(length - 1), 0) + frame_min("low", w, -(length - 1), 0)) / 2
    return F.when(full(F.col("high"), w, -(length - 1), 0), value)
