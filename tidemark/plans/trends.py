"""Candle trends, trend segments, their movements and their expansion to neighbouring tops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.functions.clock import minutes_between, plus_seconds
from tidemark.functions.ladder import minutes_of
from tidemark.operators.asof import asof_channels, asof_join
from tidemark.operators.blocks import SERIES, filled, framed, numbered, running
from tidemark.operators.ranges import islands
from tidemark.plans.tops import PEAK, VALLEY
from tidemark.session import staged

# Trend names, and the strength under which a trend counts as sideways.
BULLISH, BEARISH, SIDE = "BULLISH_TREND", "BEARISH_TREND", "SIDE_TREND"
WEAK_STRENGTH = 0.70


def top_value() -> Column:
    return F.when(F.col("top_type") == PEAK, F.col("high")).otherwise(F.col("low"))


def add_neighbour_tops(candles: DataFrame, tops: DataFrame, base_s: int, by: Sequence[str] = SERIES) -> DataFrame:
    """Time and value of the peaks and valleys next to each candle, at least one base bar away on either side."""
    rows = tops.select(*by, "date", "top_type", F.col("date").alias("time"), top_value().alias("value"))
    kinds = {k: f"top_type = '{k}'" for k in (PEAK, VALLEY)}
    out = asof_channels(
        candles, rows, ["time", "value"], {f"previous_{k}_": c for k, c in kinds.items()}, by=by,
        left_time=plus_seconds("date", -base_s),
    )
    return asof_channels(
        out, rows, ["time", "value"], {f"next_{k}_": c for k, c in kinds.items()}, by=by,
        left_time=plus_seconds("date", base_s), direction="forward",
    )


def candle_trend(with_tops: DataFrame) -> DataFrame:
    """Bullish where both the next peak and the next valley are higher, bearish where both are lower, else side.

    Candles without all four tops take the trend of the candle before (after, at the start) and are not final.
    """
    p0, p1 = F.col("previous_peak_value"), F.col("next_peak_value")
    v0, v1 = F.col("previous_valley_value"), F.col("next_valley_value")
    known = p0.isNotNull() & p1.isNotNull() & v0.isNotNull() & v1.isNotNull()
    trend = F.when((p1 > p0) & (v1 > v0), BULLISH).when((p1 < p0) & (v1 < v0), BEARISH).when(known, SIDE)
    out = with_tops.withColumn("bull_bear_side", trend)
    out = staged(out.withColumn("is_final", F.col("bull_bear_side").isNotNull()))
    # all four tops are there from some candle on until another: what lacks a trend lies before or after those
    known = out.where("is_final").groupBy(*SERIES).agg(
        F.min_by("bull_bear_side", "date").alias("_first"),
        F.max_by("bull_bear_side", "date").alias("_last"),
        F.max("date").alias("_until"),
    )
    outer = F.when(F.col("date") > F.col("_until"), F.col("_last")).otherwise(F.col("_first"))
    side = F.coalesce("bull_bear_side", outer, F.lit(SIDE))
    return out.join(known, list(SERIES), "left").withColumn("bull_bear_side", side).drop("_first", "_last", "_until")


def rally_base_drop(with_tops: DataFrame) -> DataFrame:
    """Rally where valleys rise and peaks fall towards the next tops, drop in the mirror case, else base."""
    rally = (F.col("next_valley_value") > F.col("previous_valley_value")) & (
        F.col("previous_peak_value") > F.col("next_peak_value")
    )
    drop = (F.col("next_valley_value") < F.col("previous_valley_value")) & (
        F.col("previous_peak_value") < F.col("next_peak_value")
    )
    return with_tops.withColumn("rally_base_drop", F.when(rally, "RALLY").when(drop, "DROP").otherwise("BASE"))


def trend_segments(candles: DataFrame) -> DataFrame:
    """One row per run of equal trend: its first date and, as end, the next run's start or the last candle."""

    def changes(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_before", F.lag("bull_bear_side").over(w))
        return rows.where(F.col("_before").isNull() | (F.col("_before") != F.col("bull_bear_side")))

    starts = staged(framed(candles, changes, before=1).select(*SERIES, "date", "bull_bear_side"))
    last = candles.groupBy(*SERIES).agg(F.max("date").alias("_last"))
    following = starts.select(*SERIES, "date", F.col("date").alias("end"))
    runs = asof_join(starts, following, ["end"], by=SERIES, direction="forward", allow_equal=False)
    return runs.join(last, list(SERIES)).select(
        *SERIES, "date", "bull_bear_side", F.coalesce("end", "_last").alias("end")
    )


def add_segment_extremes(trends: DataFrame, candles: DataFrame) -> DataFrame:
    """Highest high, lowest low, the first time of each, and the mean ATR of the candles of each segment.

    Candles before the first segment count to it.
    """
    starts = trends.select(*SERIES, "date", F.col("date").alias("segment"))
    first = trends.groupBy(*SERIES).agg(F.min("date").alias("_first"))
    placed = asof_join(candles.select(*SERIES, "date", "high", "low", "atr"), starts, ["segment"], by=SERIES)
    placed = placed.join(first, list(SERIES)).withColumn("segment", F.coalesce("segment", "_first"))
    folded = placed.groupBy(*SERIES, F.col("segment").alias("date")).agg(
        F.max("high").alias("internal_high"),
        F.min_by("date", F.struct(-F.col("high"), F.col("date"))).alias("high_time"),
        F.min("low").alias("internal_low"),
        F.min_by("date", F.struct(F.col("low"), F.col("date"))).alias("low_time"),
        F.avg("atr").alias("atr"),
    )
    return trends.join(folded, [*SERIES, "date"], "left")


def _runs(tops: DataFrame) -> DataFrame:
    """For each top the last top of the run of ever more extreme tops that starts at it, after it and before it."""
    sign = F.when(F.col("top_type") == PEAK, 1).otherwise(-1)
    keys = [*SERIES, "top_type"]

    def breaks(rows: DataFrame, w: WindowSpec) -> DataFrame:
        v = F.col("value") * sign
        after, before = F.lead(v).over(w), F.lag(v).over(w)
        rows = rows.withColumns({"_after": after, "_before": before, "_v": v})
        here = F.struct(F.col("date").alias("time"), "value")
        return rows.withColumns(
            {
                "run_end": F.when(F.col("_after").isNull() | (F.col("_after") < F.col("_v")), here),
                "run_start": F.when(F.col("_before").isNull() | (F.col("_before") < F.col("_v")), here),
            }
        ).drop("_after", "_before", "_v")

    rows = tops.select(*keys, "date", top_value().alias("value"))
    marked = staged(framed(numbered(rows, keys, name="_n"), breaks, before=1, after=1, keys=keys, bar="_n"))
    out = filled(marked, ["run_end"], keys, forward=False)
    return filled(out, ["run_start"], keys)


def add_movements(trends: DataFrame, tops: DataFrame, base_s: int, expand: bool = True) -> DataFrame:
    """Where the movement of each bullish and bearish segment starts and ends, and by how far.

    It starts at the first valley (peak) inside the segment and ends at the last peak (valley) inside, or at the
    segment's own ends where there is none. With `expand` the end moves on to the next peak (valley) when that is
    at least as extreme as the segment, and on along the run of tops that each are at least as extreme as the one
    before; the start moves back in the same way. Both walks end where the run of tops breaks, so one look-up of
    the run's last top replaces the walk.
    """
    rows = staged(_runs(tops)).withColumn("time", F.col("date"))
    channels = {f"{k}_": f"top_type = '{k}'" for k in (PEAK, VALLEY)}
    payload = ["time", "value"]
    out = asof_channels(
        trends, rows, payload, {f"after_{k}": c for k, c in channels.items()}, by=SERIES,
        left_time=plus_seconds("date", base_s), direction="forward",
    )
    out = asof_channels(
        out, rows, payload, {f"before_{k}": c for k, c in channels.items()}, by=SERIES,
        left_time=plus_seconds("end", -base_s),
    )
    bull = F.col("bull_bear_side") == BULLISH
    moving = F.col("bull_bear_side") != SIDE

    def by_side(bullish: str | Column, bearish: str | Column) -> Column:
        return F.when(bull, bullish if isinstance(bullish, Column) else F.col(bullish)).when(
            moving, bearish if isinstance(bearish, Column) else F.col(bearish)
        )

    start_time = by_side("after_valley_time", "after_peak_time")
    end_time = by_side("before_peak_time", "before_valley_time")
    has_start, has_end = start_time < F.col("end"), end_time > F.col("date")
    out = out.withColumns(
        {
            "movement_start_time": F.when(has_start, start_time).when(moving, F.col("date")),
            "movement_start_value": F.when(has_start, by_side("after_valley_value", "after_peak_value")).otherwise(
                by_side("internal_low", "internal_high")
            ),
            "movement_end_time": F.when(has_end, end_time).when(moving, F.col("end")),
            "movement_end_value": F.when(has_end, by_side("before_peak_value", "before_valley_value")).otherwise(
                by_side("internal_high", "internal_low")
            ),
        }
    ).drop(*[f"{side}_{k}_{c}" for side in ("after", "before") for k in (PEAK, VALLEY) for c in payload])
    if expand:
        out = _expanded(staged(out), rows, base_s, channels, by_side)
    high = F.greatest("internal_high", "movement_start_value", "movement_end_value")
    low = F.least("internal_low", "movement_start_value", "movement_end_value")
    duration = minutes_between("end", "date")
    out = out.withColumns({"movement": high - low, "duration_minutes": duration})
    out = out.withColumn(
        "rate", F.try_divide(F.col("movement"), F.col("duration_minutes") / minutes_of("timeframe"))
    )
    return out.withColumn("strength", F.try_divide("rate", "atr"))


def _expanded(trends: DataFrame, rows: DataFrame, base_s: int, channels: dict[str, str], by_side) -> DataFrame:
    out = asof_channels(
        trends, rows, ["value", "run_end"], {f"next_{k}": c for k, c in channels.items()}, by=SERIES,
        left_time=plus_seconds("movement_end_time", base_s), direction="forward",
    )
    out = asof_channels(
        out, rows, ["value", "run_start"], {f"last_{k}": c for k, c in channels.items()}, by=SERIES,
        left_time=plus_seconds("movement_start_time", -base_s),
    )
    end_on = by_side(
        F.col("next_peak_value") >= F.col("internal_high"), F.col("next_valley_value") <= F.col("internal_low")
    )
    start_on = by_side(
        F.col("last_valley_value") <= F.col("internal_low"), F.col("last_peak_value") >= F.col("internal_high")
    )
    run_end = by_side("next_peak_run_end", "next_valley_run_end")
    run_start = by_side("last_valley_run_start", "last_peak_run_start")
    out = out.withColumns({"_end": F.when(end_on, run_end), "_start": F.when(start_on, run_start)})
    new_high = by_side(F.col("_end.value"), F.col("_start.value"))
    new_low = by_side(F.col("_start.value"), F.col("_end.value"))
    return out.withColumns(
        {
            "movement_end_time": F.coalesce("_end.time", "movement_end_time"),
            "movement_end_value": F.coalesce("_end.value", "movement_end_value"),
            "movement_start_time": F.coalesce("_start.time", "movement_start_time"),
            "movement_start_value": F.coalesce("_start.value", "movement_start_value"),
            "internal_high": F.coalesce(new_high, F.col("internal_high")),
            "internal_low": F.coalesce(new_low, F.col("internal_low")),
        }
    ).select(*trends.columns)


def ignore_weak(trends: DataFrame, least: float = WEAK_STRENGTH) -> DataFrame:
    """Trends weaker than `least` count as sideways."""
    return trends.withColumn(
        "bull_bear_side", F.when(F.col("strength") < least, SIDE).otherwise(F.col("bull_bear_side"))
    )


def add_previous_trend(trends: DataFrame) -> DataFrame:
    """The trend whose movement ends where this one's starts; of several the one that moved most."""
    ended = (
        trends.where("movement_end_time is not null")
        .groupBy(*SERIES, F.col("movement_end_time").alias("movement_start_time"))
        .agg(
            F.min_by(
                F.struct("date", "movement", "movement_start_time", "movement_start_value"),
                F.struct(-F.col("movement"), F.col("date")),
            ).alias("_p")
        )
    )
    out = trends.join(ended, [*SERIES, "movement_start_time"], "left")
    return out.select(
        *trends.columns,
        F.col("_p.date").alias("previous_trend"),
        F.col("_p.movement").alias("previous_trend_movement"),
        F.col("_p.movement_start_time").alias("previous_movement_start_time"),
        F.col("_p.movement_start_value").alias("previous_movement_start_value"),
    )


def biggest_per_end(trends: DataFrame) -> DataFrame:
    """Of the trends whose movements end together keep the one that moved most, the earliest on a tie."""
    w = Window.partitionBy(*SERIES, "movement_end_time").orderBy(F.desc("movement"), "date")
    return trends.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_overlaps(trends: DataFrame) -> DataFrame:
    """Movements that overlap become one: contained ones go, the others extend it."""
    rows = trends.where("movement_start_time < movement_end_time").select(
        *SERIES, "date", "movement_start_time", "movement_end_time"
    )
    grouped = islands(staged(rows), list(SERIES), "movement_start_time", "movement_end_time")
    return grouped.groupBy(*SERIES, "island").agg(
        F.min("date").alias("date"),
        F.max("movement_end_time").alias("movement_end_time"),
        F.count(F.lit(1)).alias("merged"),
    ).withColumnRenamed("island", "movement_start_time")


def tops_of_trends(trends: DataFrame, tops: DataFrame) -> DataFrame:
    """Each top with the trend segment it lies in; a top on a border belongs to both segments."""
    starts = trends.select(*SERIES, "date", F.col("date").alias("trend"), F.col("end").alias("_end"))
    inside = asof_join(tops, starts, ["trend", "_end"], by=SERIES)
    border = asof_join(tops, starts, ["trend", "_end"], by=SERIES, allow_equal=False).where("_end = date")
    return inside.where("date <= _end").unionByName(border).drop("_end").dropDuplicates([*SERIES, "trend", "date", "top_type"])


def significant_tops(trends: DataFrame, tops: DataFrame, n: int = 2) -> DataFrame:
    """The `n` strongest peaks and valleys of each segment."""
    w = Window.partitionBy(*SERIES, "trend", "top_type").orderBy(F.desc("strength"), "date")
    return tops_of_trends(trends, tops).withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def add_channel_lines(trends: DataFrame, tops: DataFrame) -> DataFrame:
    """Line through the two strongest valleys (peaks) of a bullish (bearish) segment and its parallel through the
    strongest top on the other side; slopes per minute from the segment's start."""
    best = significant_tops(trends, tops).withColumn(
        "_p", F.struct(minutes_between("date", "trend").alias("x"), top_value().alias("y"))
    )
    pairs = best.groupBy(*SERIES, F.col("trend").alias("date")).agg(
        F.sort_array(F.collect_list(F.when(F.col("top_type") == PEAK, F.col("_p")))).alias("_peaks"),
        F.sort_array(F.collect_list(F.when(F.col("top_type") == VALLEY, F.col("_p")))).alias("_valleys"),
        F.max(F.when((F.col("top_type") == PEAK) & (F.col("n") == 1), F.col("_p"))).alias("_peak"),
        F.max(F.when((F.col("top_type") == VALLEY) & (F.col("n") == 1), F.col("_p"))).alias("_valley"),
    )
    out = trends.where(F.col("bull_bear_side") != SIDE).join(pairs, [*SERIES, "date"], "left")
    bull = F.col("bull_bear_side") == BULLISH
    line = F.when(bull, F.col("_valleys")).otherwise(F.col("_peaks"))
    far = F.when(bull, F.col("_peak")).otherwise(F.col("_valley"))
    out = out.withColumns(
        {"_a": F.try_element_at(line, F.lit(1)), "_b": F.try_element_at(line, F.lit(2)), "_c": far}
    )
    out = out.withColumn(
        "trend_slope", F.try_divide(F.col("_b.y") - F.col("_a.y"), F.col("_b.x") - F.col("_a.x"))
    )
    return out.withColumns(
        {
            "trend_base": F.col("_a.y") - F.col("_a.x") * F.col("trend_slope"),
            "channel_base": F.col("_c.y") - F.col("_c.x") * F.col("trend_slope"),
        }
    ).drop("_peaks", "_valleys", "_peak", "_valley", "_a", "_b", "_c")


def overlap_violations(trends: DataFrame, start: str = "date", end: str = "end") -> DataFrame:
    """Intervals of a series that start before an earlier one ends, with the earlier one that reaches furthest."""
    rows = trends.select(*SERIES, F.col(start).alias("start"), F.col(end).alias("end"))
    rows = running(
        staged(rows), {"_reach": ("max", F.struct("end", "start"))}, order=("start", "end"), inclusive=False
    )
    return rows.where("_reach.end > start").select(*SERIES, "start", "end", F.col("_reach.start").alias("overlaps"))
