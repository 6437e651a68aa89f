"""Base patterns: runs of small overlapping candles, and the bands they activate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.functions.clock import plus_seconds
from tidemark.functions.ladder import TF_MINUTES, minutes_of
from tidemark.operators.asof import asof_channels
from tidemark.operators.blocks import SERIES, framed
from tidemark.operators.crossing import first_crossing
from tidemark.session import staged

# Upper bounds of the candle size classes, in ATRs.
SPINNING_MAX, STANDARD_MAX, LONG_MAX = 0.80, 1.20, 2.5
# Base pattern rules.
SPINNING_CANDLES, MIN_OVERLAP, TTL_BARS, SHIFT_BARS, SMALL_BASE_ATRS = 2, 0.8, 256, 1, 3.0


def add_candle_size(df: DataFrame) -> DataFrame:
    """Class of a candle by its range in ATRs."""
    ratio = F.try_divide(F.col("high") - F.col("low"), F.col("atr"))
    size = (
        F.when(F.col("atr_ratio") <= SPINNING_MAX, "Spinning")
        .when(F.col("atr_ratio") <= STANDARD_MAX, "Standard")
        .when(F.col("atr_ratio") <= LONG_MAX, "Long")
        .when(F.col("atr_ratio") > LONG_MAX, "Spike")
    )
    return df.withColumns({"length": F.col("high") - F.col("low"), "atr_ratio": ratio}).withColumn("size", size)


def spinning_runs(df: DataFrame, n: int = SPINNING_CANDLES) -> DataFrame:
    """Candles that end `n` spinning candles in a row."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(1 - n, 0)
        spinning = F.sum((F.col("size") == "Spinning").cast("int")).over(frame)
        return rows.withColumn("_run", spinning == n).where("_run").drop("_run")

    return framed(add_candle_size(df), build, before=n - 1)


def add_overlaps(df: DataFrame, n: int = SPINNING_CANDLES) -> DataFrame:
    """For each of the last `n` candles what it shares with the candle before it, as an array, newest first."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        low = F.greatest("low", F.lag("low").over(w))
        high = F.least("high", F.lag("high").over(w))
        rows = rows.withColumns({"_lo": low, "_hi": high, "_len": F.col("high") - F.col("low")})
        shared = F.struct(
            (F.col("_hi") - F.col("_lo")).alias("length"),
            F.col("_lo").alias("low"),
            F.col("_hi").alias("high"),
            F.coalesce(F.try_divide(F.col("_hi") - F.col("_lo"), F.col("_len")), F.lit(0.0)).alias("overlap"),
        )
        rows = rows.withColumn("_shared", shared)
        return rows.withColumn(
            "shared", F.reverse(F.collect_list("_shared").over(w.rowsBetween(1 - n, 0)))
        ).drop("_lo", "_hi", "_len", "_shared")

    return framed(df, build, before=n)


def base_candles(df: DataFrame, n: int = SPINNING_CANDLES, least_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Bases: `n` spinning candles that each lie mostly inside the one before, with the range all of them share.

    Where they share none, the smallest of the shared ranges stands for the base (`zero_trigger_candle`).
    """

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        spinning = F.sum((F.col("size") == "Spinning").cast("int")).over(w.rowsBetween(1 - n, 0))
        return rows.withColumn("_spinning", spinning)

    rows = framed(add_overlaps(add_candle_size(df), n), build, before=n - 1).where(F.col("_spinning") == n)
    rows = rows.where(F.forall("shared", lambda s: s["overlap"] > least_overlap))
    rows = rows.withColumns(
        {
            "_low": F.array_max(F.transform("shared", lambda s: s["low"])),
            "_high": F.array_min(F.transform("shared", lambda s: s["high"])),
        }
    )
    shortest = F.array_min(F.transform("shared", lambda s, i: F.struct(s["length"], i, s["low"], s["high"])))
    rows = rows.withColumns({"zero_trigger_candle": F.col("_high") <= F.col("_low"), "_short": shortest})
    return rows.withColumns(
        {
            "internal_low": F.when(F.col("zero_trigger_candle"), F.col("_short.low")).otherwise(F.col("_low")),
            "internal_high": F.when(F.col("zero_trigger_candle"), F.col("_short.high")).otherwise(F.col("_high")),
        }
    ).drop("_low", "_high", "_short", "_spinning", "shared")


def first_passed(
    bases: DataFrame, candles: DataFrame, level: str, column: str, comparator: str, base_tf: str, out: str,
    longest_s: int | None = None,
) -> DataFrame:
    """First base candle from one bar after the base until its `ttl` that passes the level.

    No `ttl` is more than `longest_s` seconds after that bar; the search then only looks at blocks that near.
    """
    start = plus_seconds("date", minutes_of("timeframe") * 60 * SHIFT_BARS)
    found = first_crossing(
        bases, candles, level, column, comparator, TF_MINUTES[base_tf] * 60, base_time=start, same_time=True, within_s=longest_s
    )
    hit = F.col("right_crossing_time")
    return found.withColumn(out, F.when(hit <= F.col("ttl"), hit)).drop("right_crossing_time", "right_crossing_value")


def base_patterns(
    mt_candles: DataFrame, timeframes: Sequence[str], ladder: Sequence[str], n: int = SPINNING_CANDLES,
    least_overlap: float = MIN_OVERLAP, ttl_bars: int = TTL_BARS, band_atrs: float = 1.0,
) -> DataFrame:
    """Base patterns of several timeframes of a stacked table with ATR; `ladder[0]` is the base timeframe.

    Each carries its own ATR, those of the timeframes one and two above at its start, the base candle's ATR at
    its start, and when the price left it far enough to activate its upper or lower band.
    """
    valid = mt_candles.where("atr is not null")
    base_tf = ladder[0]
    bases = base_candles(valid.where(F.col("timeframe").isin(list(timeframes))), n, least_overlap)
    bases = bases.select(*SERIES, "date", "internal_low", "internal_high", "atr", "zero_trigger_candle")
    bases = bases.withColumn("ttl", plus_seconds("date", minutes_of("timeframe") * 60 * ttl_bars))
    atrs = valid.select("symbol", "date", F.col("timeframe").alias("_tf"), F.col("atr").alias("value"))
    channels = {f"{tf}_": f"_tf = '{tf}'" for tf in ladder}
    out = asof_channels(staged(bases), atrs, ["value"], channels)

    def above(steps: int) -> Column:
        value = F.lit(None).cast("double")
        for i, tf in enumerate(ladder):
            if i + steps < len(ladder):
                value = F.when(F.col("timeframe") == tf, F.col(f"{ladder[i + steps]}_value")).otherwise(value)
        return value

    out = out.withColumns({"a_pattern_atr": above(1), "a_trigger_atr": above(2)}).drop(*[f"{tf}_value" for tf in ladder])
    base_candles_only = valid.where(F.col("timeframe") == base_tf).drop("timeframe")
    own = base_candles_only.select("symbol", "date", F.col("atr").alias("base_timeframe_atr"))
    out = out.join(own, ["symbol", "date"], "left").withColumns(
        {
            "size": F.col("internal_high") - F.col("internal_low"),
            "_upper": F.col("internal_low") - F.col("atr") * band_atrs,
            "_below": F.col("internal_high") + F.col("atr") * band_atrs,
        }
    )
    out = out.withColumn("ignore_backtesting", F.col("size") < F.col("base_timeframe_atr") * SMALL_BASE_ATRS)
    longest = max(TF_MINUTES[tf] for tf in timeframes) * 60 * ttl_bars
    out = first_passed(staged(out), base_candles_only, "_upper", "low", "lt", base_tf, "upper_band_activated", longest)
    out = first_passed(staged(out), base_candles_only, "_below", "high", "gt", base_tf, "below_band_activated", longest)
    return out.drop("_upper", "_below").withColumn("end", F.lit(None).cast("timestamp_ntz"))
