"""The timeframe ladder: widths, ranks, neighbours, and the bar number of a date."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.clock import DAY_S, col, epoch_s, from_epoch_s

# Timeframe names and widths in minutes (1M = 30 days, 1Y = 365 days).
TF_MINUTES: dict[str, int] = {
    "1min": 1,
    "5min": 5,
    "15min": 15,
    "1h": 60,
    "4h": 240,
    "1D": 1440,
    "1W": 10080,
    "1M": 43200,
    "4M": 172800,
    "1Y": 525600,
}
# The rungs extremum sizes snap to.
RUNGS: list[str] = ["5min", "15min", "1h", "4h", "1D", "1W", "1M", "4M", "1Y"]
# The timeframes candles are kept in, and role shifts on that list.
CANDLE_TIMEFRAMES: list[str] = ["1min", "5min", "15min", "1h", "4h", "1D", "1W"]
ROLE_SHIFT: dict[str, int] = {"structure": 0, "pattern": -1, "trigger": -2, "double": -4, "hat_trick": -6}

# Weeks start on Monday; 1970-01-05 was one.
WEEK_OFFSET_S = 4 * DAY_S


def ladder(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The ladder as a table `(timeframe, minutes, rank)`; at most ten rows, safe to broadcast."""
    names = names or list(TF_MINUTES)
    rows = [(n, TF_MINUTES[n], i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "timeframe string, minutes int, rank int")


def shifted(name: str, steps: int, names: list[str] = RUNGS) -> str | None:
    """The timeframe `steps` rungs above (below if negative) or None past an end."""
    i = names.index(name) + steps
    return names[i] if 0 <= i < len(names) else None


def _lookup(timeframe: str | Column, values: dict[str, object]) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())
    return F.try_element_at(F.create_map(*pairs), col(timeframe))


def minutes_of(timeframe: str | Column = "timeframe") -> Column:
    return _lookup(timeframe, TF_MINUTES)


def rank_of(timeframe: str | Column = "timeframe") -> Column:
    return _lookup(timeframe, {n: i for i, n in enumerate(TF_MINUTES)})


def shifted_of(timeframe: str | Column, steps: int, names: list[str] = RUNGS) -> Column:
    """Column form of `shifted`."""
    return _lookup(timeframe, {n: shifted(n, steps, names) for n in names if shifted(n, steps, names)})


def floor_to_ladder(minutes: Column) -> Column:
    """Largest rung not above `minutes`; 0 below the first; NULL stays NULL."""
    out = F.when(minutes.isNull(), F.lit(None).cast("double"))
    for name in reversed(RUNGS):
        out = out.when(minutes >= TF_MINUTES[name], F.lit(float(TF_MINUTES[name])))
    return out.otherwise(F.lit(0.0))


def bar_of(date: str | Column, tf: str) -> Column:
    """Number of the bar that holds `date`: consecutive bars differ by one, whatever the series start."""
    if tf in ("1M", "4M", "1Y"):
        months = F.year(col(date)) * 12 + F.month(col(date)) - 1
        return F.floor(months / {"1M": 1, "4M": 4, "1Y": 12}[tf]).cast("long")
    offset = WEEK_OFFSET_S if tf == "1W" else 0
    return F.floor((epoch_s(date) - offset) / F.lit(TF_MINUTES[tf] * 60)).cast("long")


def start_of_bar(bar: str | Column, tf: str) -> Column:
    """First instant of a bar."""
    if tf in ("1M", "4M", "1Y"):
        months = col(bar) * {"1M": 1, "4M": 4, "1Y": 12}[tf]
        first = F.make_date(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1))
        return first.cast("timestamp_ntz")
    offset = WEEK_OFFSET_S if tf == "1W" else 0
    return from_epoch_s(col(bar) * (TF_MINUTES[tf] * 60) + offset)


def floor_to_bar(date: str | Column, tf: str) -> Column:
    return start_of_bar(bar_of(date, tf), tf)


def bar_of_stacked(date: str | Column = "date", timeframe: str | Column = "timeframe") -> Column:
    """`bar_of` for a stacked table, the timeframe being a column (fixed-width timeframes)."""
    offset = F.when(col(timeframe) == "1W", WEEK_OFFSET_S).otherwise(0)
    return F.floor((epoch_s(date) - offset) / (minutes_of(timeframe) * 60)).cast("long")
