"""Peaks and valleys, how long they stay unbeaten, and the timeframe that gives them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.functions.clock import epoch_s, minutes_between
from tidemark.functions.ladder import CANDLE_TIMEFRAMES, TF_MINUTES, floor_to_ladder
from tidemark.operators.blocks import SERIES, framed, numbered
from tidemark.operators.crossing import first_crossing
from tidemark.session import staged

# Names of the two kinds of tops.
PEAK, VALLEY = "peak", "valley"


def _one_kind(candles: DataFrame, kind: str) -> DataFrame:
    column, sign = ("high", 1) if kind == PEAK else ("low", -1)

    def first_of_run(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_before", F.lag(column).over(w))
        return rows.where(F.col("_before").isNull() | (F.col("_before") != F.col(column)))

    def beats_both(rows: DataFrame, w: WindowSpec) -> DataFrame:
        after = F.lead(column).over(w)
        above = (F.col(column) * sign > F.col("_before") * sign) & (F.col(column) * sign > after * sign)
        return rows.withColumn("_top", above)

    runs = numbered(framed(candles, first_of_run, before=1), name="_run")
    return (
        framed(runs, beats_both, after=1, bar="_run")
        .where("_top")
        .drop("_before", "_run", "_top")
        .withColumn("top_type", F.lit(kind))
    )


def find_tops(candles: DataFrame) -> DataFrame:
    """Highs above (lows below) both neighbours; a run of equal values counts once, at its first bar."""
    return _one_kind(candles, PEAK).unionByName(_one_kind(candles, VALLEY))


def both_kinds(candles: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Each candle once per kind of top, as a value that is 'higher' when it is more extreme."""
    kinds = F.array(
        F.struct(F.lit(PEAK).alias("top_type"), F.col("high").alias("v")),
        F.struct(F.lit(VALLEY).alias("top_type"), (-F.col("low")).alias("v")),
    )
    return candles.select(*keys, "date", F.explode(kinds).alias("_k")).select(*keys, "date", "_k.top_type", "_k.v")


def extremeness() -> Column:
    """The top's own value on the scale of `both_kinds`."""
    return F.when(F.col("top_type") == PEAK, F.col("high")).otherwise(-F.col("low"))


def add_strength(tops: DataFrame, candles: DataFrame, base_tf: str, **crossing_options) -> DataFrame:
    """Seconds to the nearest more extreme candle on either side, capped by the ends of the series.

    `permanent_strength`: the capping did not matter, so more data cannot change the strength.
    """
    keys = [*SERIES, "top_type"]
    target = both_kinds(candles)
    options = {"bar_s": TF_MINUTES[base_tf] * 60, "by": keys, **crossing_options}
    out = first_crossing(tops, target, extremeness(), "v", "gt", directions=("right", "left"), **options)
    ends = candles.groupBy(*SERIES).agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    now = epoch_s("date")
    beaten = F.least(epoch_s("right_crossing_time") - now, now - epoch_s("left_crossing_time"))
    out = out.join(ends, list(SERIES)).withColumns(
        {"_beaten": beaten, "_from_start": now - epoch_s("_first"), "_to_end": epoch_s("_last") - now}
    )
    return out.withColumns(
        {
            "strength": F.least("_beaten", "_from_start", "_to_end"),
            "permanent_strength": (F.col("_beaten") < F.col("_from_start")) & (F.col("_beaten") < F.col("_to_end")),
        }
    ).select(*tops.columns, "strength", "permanent_strength")


def top_timeframe(strength_s: Column, timeframes: Sequence[str] = CANDLE_TIMEFRAMES) -> Column:
    """Highest timeframe of which the strength holds two bars; the first one at least."""
    out = F.lit(timeframes[0])
    for tf in timeframes[1:]:
        out = F.when(strength_s >= TF_MINUTES[tf] * 120, tf).otherwise(out)
    return out


def strength_timeframe(strength_s: Column, timeframes: Sequence[str] = CANDLE_TIMEFRAMES) -> Column:
    """Other rule: highest timeframe whose width the strength exceeds, NULL if none."""
    out = F.lit(None).cast("string")
    for tf in timeframes:
        out = F.when(strength_s > TF_MINUTES[tf] * 60, tf).otherwise(out)
    return out


def timeframe_tops(
    candles: DataFrame, base_tf: str, timeframes: Sequence[str], start: str | None = None, end: str | None = None
) -> DataFrame:
    """Tops of the base candles with strength and timeframe, cut to the open range if one is given."""
    tops = add_strength(staged(find_tops(candles)), candles, base_tf)
    tops = tops.withColumn("timeframe", top_timeframe(F.col("strength"), timeframes))
    if start is not None:
        tops = tops.where((F.col("date") > F.lit(start).cast("timestamp_ntz")) & (F.col("date") < F.lit(end).cast("timestamp_ntz")))
    return tops


def effective_tops(tops: DataFrame, timeframes: Sequence[str]) -> DataFrame:
    """A top counts for its own timeframe and every lower one: one row per timeframe it counts for."""
    rank = {tf: i for i, tf in enumerate(timeframes)}
    own = F.lit(0)
    for tf, i in rank.items():
        own = F.when(F.col("timeframe") == tf, i).otherwise(own)
    names = F.array(*[F.lit(tf) for tf in timeframes])
    return tops.withColumn("timeframe", F.explode(F.slice(names, F.lit(1), own + 1)))


def add_true_extremum(candles: DataFrame, base_tf: str, **crossing_options) -> DataFrame:
    """Minutes until a bar is matched or beaten, as a peak and as a valley; which of the two it is more of; and
    that reach on the ladder. A bar nothing ever matches has an infinite reach."""
    target = both_kinds(candles)
    base = target.withColumnRenamed("v", "_own")
    keys = [*SERIES, "top_type"]
    options = {"bar_s": TF_MINUTES[base_tf] * 60, "by": keys, **crossing_options}
    out = first_crossing(base, target, "_own", "v", "ge", directions=("right", "left"), **options)
    inf = F.lit(float("inf"))
    reach = F.least(
        F.coalesce(minutes_between("right_crossing_time", "date"), inf),
        F.coalesce(minutes_between("date", "left_crossing_time"), inf),
    )
    wide = (
        out.withColumn("_reach", reach)
        .groupBy(*SERIES, "date")
        .agg(
            F.max(F.when(F.col("top_type") == PEAK, F.col("_reach"))).alias("true_peak_reach_minutes"),
            F.max(F.when(F.col("top_type") == VALLEY, F.col("_reach"))).alias("true_valley_reach_minutes"),
        )
    )
    size = floor_to_ladder(F.greatest("true_peak_reach_minutes", "true_valley_reach_minutes"))
    peak_wins = F.col("true_peak_reach_minutes") >= F.col("true_valley_reach_minutes")
    wide = wide.withColumn("true_extremum_tf_minutes", size).withColumn(
        "extremum_sign",
        F.when(F.col("true_extremum_tf_minutes") == 0, 0).when(peak_wins, 1).otherwise(-1),
    )
    return candles.join(wide, [*SERIES, "date"])
