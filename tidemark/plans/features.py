"""Causal candle features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.functions.clock import minutes_between
from tidemark.functions.ladder import floor_to_ladder
from tidemark.operators.blocks import framed
from tidemark.operators.smoothing import add_atr, add_rma, sma

ATR_LENGTH = 256
VOLUME_RMA_LENGTH = 14
# Fixed value: the double-precision epsilon inside the volume logarithm.
EPS = 2.220446049250313e-16


def relative_ratios(w: WindowSpec) -> dict[str, Column]:
    """Close, high-close, close-low, open gap and height over the `atr` column."""

    def per_atr(c: Column) -> Column:
        return F.try_divide(c, F.col("atr"))

    return {
        "rel_close": per_atr(F.col("close")),
        "rel_high_close": per_atr(F.col("high") - F.col("close")),
        "rel_close_low": per_atr(F.col("close") - F.col("low")),
        "open_gap": per_atr(F.col("open") - F.lag("close").over(w)),
        "rel_candle_height": per_atr(F.col("high") - F.col("low")),
    }


def add_relative_candle(df: DataFrame, atr_length: int = ATR_LENGTH) -> DataFrame:
    """Candle ratios over the ATR, which is added when it is missing."""
    if "atr" not in df.columns:
        df = add_atr(df, atr_length)
    return framed(df, lambda rows, w: rows.withColumns(relative_ratios(w)), before=1)


def add_volume_rma(df: DataFrame, length: int = VOLUME_RMA_LENGTH, out: str = "volume_atr") -> DataFrame:
    """Volume over Wilder's mean of the volume; a zero mean gives NULL."""
    return add_rma(df, "volume", length, "_rma").withColumn(out, F.try_divide("volume", "_rma")).drop("_rma")


def log_sma_ratio(w: WindowSpec, length: int) -> Column:
    """Logarithm of volume over its plain mean."""
    return F.ln((F.col("volume") + EPS) / (sma(F.col("volume"), w, length) + EPS))


def add_log_sma_volume(df: DataFrame, length: int = 256) -> DataFrame:
    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("log_volume_sma_ratio", log_sma_ratio(w, length))

    return framed(df, build, before=length - 1)


def candles_with_atr(df: DataFrame, start: str, end: str, atr_length: int = ATR_LENGTH) -> DataFrame:
    """OHLCVA: ATR and volume ratio computed with the history before `start`, then complete rows of the range."""
    out = add_volume_rma(add_atr(df, atr_length), out="volume_rma")
    inside = F.col("date").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return out.where(inside).dropna(subset=["atr", "volume_rma"])


def observed_extremum(true_minutes: Column, anchor: str | Column, date: str | Column) -> Column:
    """Extremum size an observer at `anchor` may know: not more than the age of the bar."""
    return F.least(true_minutes, floor_to_ladder(minutes_between(anchor, date)))


def extremum_weight(sign: Column, true_minutes: Column, anchor, date, tf_minutes: float) -> Column:
    """Signed log size, faded in while the bar is younger than its size; 0 when nothing is observed."""
    age = minutes_between(anchor, date)
    seen = observed_extremum(true_minutes, anchor, date)
    raw = sign * F.log1p(seen / tf_minutes) * F.least(F.lit(1.0), F.try_divide(age, seen))
    return F.when(seen == 0, F.lit(0.0)).otherwise(raw)
