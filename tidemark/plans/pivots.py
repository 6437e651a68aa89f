"""Pivots: levels with margins, where they come from, and how they live, flip and end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.clock import plus_seconds
from tidemark.functions.ladder import TF_MINUTES, minutes_of, rank_of
from tidemark.operators.asof import asof_join
from tidemark.operators.blocks import SERIES, framed, numbered
from tidemark.operators.crossing import first_crossing
from tidemark.operators.ranges import best_covering, interval_join
from tidemark.plans.tops import PEAK, extremeness
from tidemark.plans.trends import add_previous_trend, biggest_per_end, top_value
from tidemark.session import staged

# Life of a level in bars, hits until it is used up, share of the movement bases are looked for in,
# and how many ATRs the price must come before and leave after a pivot.
TTL_BARS, ACTIVE_HITS, PRICE_RANGE = 512, 2, 0.38
BEFORE_ATRS, AFTER_ATRS = 3.0, 1.0


def add_level_and_margins(pivots: DataFrame, candles: DataFrame, atr_candles: DataFrame | None = None) -> DataFrame:
    """Level, inner margin (candle body nearest to the level) and outer margin (one ATR beyond the level).

    `pivots` has `(symbol, timeframe, date, top_type, high, low)`. Body and ATR come from the last candle of the
    pivot's timeframe that starts at or before it; `atr_candles` may give the ATR from another source.
    """
    bodies = candles.select(
        *SERIES, "date", F.greatest("open", "close").alias("_body_high"), F.least("open", "close").alias("_body_low"),
        F.col("atr").alias("_atr"),
    )
    out = asof_join(pivots, bodies, ["_body_high", "_body_low", "_atr"], by=SERIES)
    if atr_candles is not None:
        other = atr_candles.select(*SERIES, "date", F.col("atr").alias("_atr"))
        out = asof_join(out.drop("_atr"), other, ["_atr"], by=SERIES)
    peak = F.col("top_type") == PEAK
    out = out.withColumns({"level": top_value(), "is_resistance": peak})
    return out.withColumns(
        {
            "internal_margin": F.when(peak, F.col("_body_high")).otherwise(F.col("_body_low")),
            "external_margin": F.when(peak, F.col("level") + F.col("_atr")).otherwise(F.col("level") - F.col("_atr")),
            "ttl": plus_seconds("date", minutes_of("timeframe") * 60 * TTL_BARS),
        }
    ).drop("_body_high", "_body_low", "_atr")


def trend_pivots(trends: DataFrame, tops: DataFrame, candles: DataFrame) -> DataFrame:
    """Starts of trends that move more than an ATR after one that moved more than three.

    `tops` holds one row per timeframe a top counts for. The pivot sits on the top where the movement starts.
    """
    rows = add_previous_trend(trends)
    rows = rows.where((F.col("movement") > F.col("atr")) & (F.col("previous_trend_movement") > 3 * F.col("atr")))
    rows = biggest_per_end(rows.where("movement_end_time is not null"))
    pivots = rows.select(
        *SERIES,
        F.col("movement_start_time").alias("date"),
        F.col("previous_movement_start_time").alias("movement_start_time"),
        F.col("previous_movement_start_value").alias("movement_start_value"),
        F.col("movement_end_time").alias("return_end_time"),
        F.col("movement_end_value").alias("return_end_value"),
    )
    on_tops = pivots.join(tops.select(*SERIES, "date", "top_type", "high", "low"), [*SERIES, "date"])
    return add_level_and_margins(staged(on_tops), candles)


def major_top_pivots(tops: DataFrame, candles: DataFrame, ladder: Sequence[str]) -> DataFrame:
    """Tops of a timeframe as levels of the timeframe two below, once that much history is there.

    `tops` holds each top once, with its own timeframe.
    """
    lower = F.lit(None).cast("string")
    for i in range(2, len(ladder)):
        lower = F.when(F.col("timeframe") == ladder[i], ladder[i - 2]).otherwise(lower)
    first = candles.groupBy("symbol").agg(F.min("date").alias("_first"))
    rows = tops.join(first, ["symbol"]).where(
        F.col("date") >= plus_seconds("_first", minutes_of("timeframe") * 60)
    )
    rows = rows.withColumn("timeframe", lower).where("timeframe is not null")
    rows = rows.select(*SERIES, "date", "top_type", "high", "low")
    return add_level_and_margins(staged(rows), candles)


def add_pivot_movements(
    tops: DataFrame, base_candles: DataFrame, base_tf: str, before: float = BEFORE_ATRS, after: float = AFTER_ATRS
) -> DataFrame:
    """Last base candle `before` ATRs away before each top and first one `after` ATRs away after it."""
    sides = both_sides(base_candles)
    up = F.col("top_type") == PEAK

    def level(atrs: float) -> Column:
        # the other side's price, negated for valleys, so that 'beaten' always means far enough away
        return F.when(up, F.col("high") - atrs * F.col("atr")).otherwise(-(F.col("low") + atrs * F.col("atr")))

    options = {"bar_s": TF_MINUTES[base_tf] * 60, "by": ["symbol", "top_type"]}
    out = first_crossing(tops, sides, level(before), "v", "lt", directions=("left",), **options)
    out = first_crossing(staged(out), sides, level(after), "v", "lt", directions=("right",), **options)
    sign = F.when(up, 1.0).otherwise(-1.0)
    return out.withColumns(
        {
            "movement_start_time": F.col("left_crossing_time"),
            "movement_start_value": F.col("left_crossing_value") * sign,
            "return_end_time": F.col("right_crossing_time"),
            "return_end_value": F.col("right_crossing_value") * sign,
        }
    ).drop("left_crossing_time", "left_crossing_value", "right_crossing_time", "right_crossing_value")


def both_sides(candles: DataFrame) -> DataFrame:
    """Each candle per kind of top, as the price that moves away from such a top: lows, or negated highs."""
    kinds = F.array(
        F.struct(F.lit("peak").alias("top_type"), F.col("low").alias("v")),
        F.struct(F.lit("valley").alias("top_type"), (-F.col("high")).alias("v")),
    )
    return candles.select("symbol", "date", F.explode(kinds).alias("_k")).select("symbol", "date", "_k.*")


def add_more_significant_tops(pivots: DataFrame, tops: DataFrame, base_tf: str) -> DataFrame:
    """Nearest more extreme top of the same kind on either side."""
    target = tops.select("symbol", "date", "top_type", extremeness().alias("v"))
    out = first_crossing(
        pivots, target, extremeness(), "v", "gt", TF_MINUTES[base_tf] * 60, directions=("left", "right"),
        by=["symbol", "top_type"],
    )
    return out.withColumnsRenamed(
        {
            "left_crossing_time": "left_more_significant_top",
            "left_crossing_value": "left_more_significant_value",
            "right_crossing_time": "right_more_significant_top",
            "right_crossing_value": "right_more_significant_value",
        }
    )


def mark_major(pivots: DataFrame) -> DataFrame:
    """Of the pivots of one instant the one of the largest timeframe is the major one."""
    w = Window.partitionBy("symbol", "date", "top_type").orderBy(F.desc(rank_of("timeframe")))
    return pivots.withColumn("major_timeframe", F.row_number().over(w) == 1)


def atr_movement_pivots(
    tops: DataFrame, effective: DataFrame, candles: DataFrame, base_tf: str, timeframes: Sequence[str],
    before: float = BEFORE_ATRS, after: float = AFTER_ATRS,
) -> DataFrame:
    """Tops the price came to over `before` ATRs and left by `after`, without a more extreme top on either way.

    `tops` holds each top once, `effective` once per timeframe it counts for, `candles` all timeframes with ATR.
    """
    rows = effective.where(F.col("timeframe").isin(list(timeframes)))
    atrs = candles.where("atr is not null").select(*SERIES, "date", "atr")
    rows = asof_join(rows.select(*SERIES, "date", "top_type", "high", "low"), atrs, ["atr"], by=SERIES)
    base = candles.where(F.col("timeframe") == base_tf)
    rows = add_pivot_movements(staged(rows), base, base_tf, before, after)
    rows = rows.where("movement_start_time is not null and return_end_time is not null")
    rows = add_more_significant_tops(staged(rows), tops, base_tf)
    left, right = F.col("left_more_significant_top"), F.col("right_more_significant_top")
    kept = rows.where(
        (left.isNull() | (left <= F.col("movement_start_time"))) & (right.isNull() | (right >= F.col("return_end_time")))
    )
    return mark_major(kept)


def add_real_start(pivots: DataFrame, tops: DataFrame) -> DataFrame:
    """Where the movement to a pivot really began: the last top of the other kind, at or before the movement's
    start, that is more extreme than the one before it; else the first such top; else the movement's own start.

    `tops` holds one row per timeframe a top counts for.
    """
    def steps(rows: DataFrame, w) -> DataFrame:
        before = F.lag("value").over(w)
        further = F.when(F.col("top_type") == PEAK, F.col("value") > before).otherwise(F.col("value") < before)
        return rows.withColumn("turned", F.coalesce(further, F.lit(False)))

    keys = [*SERIES, "top_type"]
    rows = staged(tops.select(*keys, "date", top_value().alias("value")))
    flagged = framed(numbered(rows, keys, name="_n"), steps, before=1, keys=keys, bar="_n")
    flagged = staged(flagged.withColumn("time", F.col("date")))
    first = flagged.groupBy(*keys).agg(F.min_by(F.struct("time", "value"), "date").alias("_first"))
    opposite = F.when(F.col("is_resistance"), "valley").otherwise(PEAK)
    out = pivots.withColumn("_own_type", F.col("top_type")).withColumn("top_type", opposite)
    out = asof_join(
        out, flagged.where("turned"), ["time", "value"], by=keys, left_time="movement_start_time", prefix="_turn_"
    )
    out = out.join(first, keys, "left")
    seen = F.col("_first.time") <= F.col("movement_start_time")
    out = out.withColumns(
        {
            "real_start_time": F.coalesce(
                "_turn_time", F.when(seen, F.col("_first.time")), F.col("movement_start_time")
            ),
            "real_start_value": F.coalesce(
                "_turn_value", F.when(seen, F.col("_first.value")), F.col("movement_start_value")
            ),
            "real_start_permanent": F.col("_turn_time").isNotNull(),
        }
    )
    out = out.withColumn("top_type", F.col("_own_type")).drop("_own_type", "_turn_time", "_turn_value", "_first")
    return out.withColumn("real_movement", F.col("level") - F.col("real_start_value"))


def add_range_start_time(pivots: DataFrame, base_candles: DataFrame, base_tf: str) -> DataFrame:
    """Last earlier candle beyond the start of the pivot's price range."""
    sides = both_sides(base_candles)
    level = F.when(F.col("top_type") == PEAK, F.col("range_start_value")).otherwise(-F.col("range_start_value"))
    out = first_crossing(
        pivots, sides, level, "v", "lt", TF_MINUTES[base_tf] * 60, directions=("left",), by=["symbol", "top_type"]
    )
    return out.withColumnRenamed("left_crossing_time", "range_start_time").drop("left_crossing_value")


def add_price_range(pivots: DataFrame, share: float = PRICE_RANGE) -> DataFrame:
    """The last part of the real movement before the level, as a price range."""
    start = F.col("level") - F.col("real_movement") * share
    return pivots.withColumn("range_start_value", start).withColumns(
        {
            "range_low": F.least("range_start_value", "level"),
            "range_high": F.greatest("range_start_value", "level"),
        }
    )


def _candidate_bases(pivots: DataFrame, bases: DataFrame, ladder: Sequence[str], start: str, end: str) -> DataFrame:
    """Bases of the pivot's timeframe or a lower one whose `start … end` holds the pivot.

    Pivots are sent once to each timeframe they may use; a base lives a known number of its own bars, which is the
    bucket the two meet in, so a pivot meets only the bases alive around it.
    """
    rank = {tf: i for i, tf in enumerate(ladder)}
    own = F.lit(0)
    for tf, i in rank.items():
        own = F.when(F.col("timeframe") == tf, i).otherwise(own)
    names = F.array(*[F.lit(tf) for tf in ladder])
    p = pivots.withColumn("base_timeframe", F.explode(F.slice(names, F.lit(1), own + 1)))
    width = minutes_of("base_timeframe") * 60 * 256
    b = bases.withColumnsRenamed({"timeframe": "base_timeframe"}).withColumn("base_date", F.col(start))
    return interval_join(
        p, b, ["symbol", "base_timeframe"], "date", start, end, width, ["base_date", "internal_low", "internal_high"]
    )


def bases_in_price_range(pivots: DataFrame, bases: DataFrame, ladder: Sequence[str]) -> DataFrame:
    """For each pivot the bases alive at it whose low lies in its price range, as an array of structs.

    Only the largest timeframe (the pivot's own or lower) that has any counts. Pivots without bases keep NULL.
    """
    found = _candidate_bases(pivots, bases, ladder, "date", "ttl").where(
        (F.col("internal_low") < F.col("range_high")) & (F.col("internal_low") > F.col("range_low"))
    )
    return _largest_timeframe_only(pivots, found)


def bases_in_time_range(pivots: DataFrame, bases: DataFrame, ladder: Sequence[str]) -> DataFrame:
    """For each pivot the bases between the start of its range and itself, largest timeframe only."""
    rank = {tf: i for i, tf in enumerate(ladder)}
    own = F.lit(0)
    for tf, i in rank.items():
        own = F.when(F.col("timeframe") == tf, i).otherwise(own)
    names = F.array(*[F.lit(tf) for tf in ladder])
    p = pivots.where("range_start_time is not null").withColumn(
        "base_timeframe", F.explode(F.slice(names, F.lit(1), own + 1))
    )
    keep = [c for c in pivots.columns if c != "symbol"]
    b = bases.select(
        "symbol", F.col("timeframe").alias("base_timeframe"), F.col("date").alias("base_date"), "internal_low",
        "internal_high",
    )
    width = minutes_of("base_timeframe") * 60 * 256
    met = interval_join(
        b, p.withColumnsRenamed({"date": "_pivot_date"}), ["symbol", "base_timeframe"], "base_date", "range_start_time",
        "_pivot_date", width, [c if c != "date" else "_pivot_date" for c in keep], include_end=False,
    ).withColumnRenamed("_pivot_date", "date")
    return _largest_timeframe_only(pivots, met.where("base_date > range_start_time"))


def _largest_timeframe_only(pivots: DataFrame, found: DataFrame) -> DataFrame:
    key = [*SERIES, "date", "top_type"]
    per_tf = found.groupBy(*key, "base_timeframe").agg(
        F.sort_array(F.collect_list(F.struct("base_date", "internal_low", "internal_high"))).alias("bases")
    )
    best = per_tf.groupBy(*key).agg(
        F.max_by(F.struct("base_timeframe", "bases"), rank_of("base_timeframe")).alias("_b")
    )
    return pivots.join(best, key, "left").select(
        *pivots.columns, F.col("_b.base_timeframe").alias("base_timeframe"), F.col("_b.bases").alias("bases")
    )


def add_master_pivot(pivots: DataFrame) -> DataFrame:
    """The pivot of the largest timeframe, the earliest of them, whose margins hold this pivot's level."""
    marked = pivots.withColumns(
        {
            "_low": F.least("internal_margin", "external_margin"),
            "_high": F.greatest("internal_margin", "external_margin"),
            "pivot_timeframe": F.col("timeframe"),
            "pivot_date": F.col("date"),
        }
    )
    out = best_covering(
        pivots, marked, ["symbol"], "level", "_low", "_high",
        [rank_of("timeframe"), -F.unix_micros(F.col("date").cast("timestamp"))], ["pivot_timeframe", "pivot_date"],
        prefix="master_",
    )
    return out


# --- life of a pivot -------------------------------------------------------------------------------------
# Pivots and candles of all timeframes go through each search together; `tf` is the smallest one, which sets the block length.
PIVOT_SIDE = ["symbol", "timeframe", "is_resistance"]


def add_passing(pivots: DataFrame, candles: DataFrame, tf: str) -> DataFrame:
    """First candle wholly beyond the outer margin: low above it for a resistance, high below it for a support."""
    kinds = F.array(
        F.struct(F.lit(True).alias("is_resistance"), F.col("low").alias("v")),
        F.struct(F.lit(False).alias("is_resistance"), (-F.col("high")).alias("v")),
    )
    sides = candles.select(*SERIES, "date", F.explode(kinds).alias("_k")).select(*SERIES, "date", "_k.*")
    level = F.when(F.col("is_resistance"), F.col("external_margin")).otherwise(-F.col("external_margin"))
    out = first_crossing(pivots, sides, level, "v", "gt", TF_MINUTES[tf] * 60, by=PIVOT_SIDE)
    return out.withColumnRenamed("right_crossing_time", "passing_time").drop("right_crossing_value")


def flip_on_passing(pivots: DataFrame, candles: DataFrame, tf: str) -> DataFrame:
    """Pass, flip, pass again: each passing ends a pivot and starts its mirror with swapped margins.

    Rounds go on while some pivot is passed before its `ttl`; each searches only the pivots the last one made, and
    each flip starts later than the one before, so the `ttl` bounds their number. Every round is staged.
    """
    now = pivots.withColumns({"original_start": F.col("date"), "flips": F.lit(0)})
    rounds = []
    while True:
        done = staged(add_passing(now, candles, tf))
        rounds.append(done)
        passed = done.where("passing_time < ttl")
        if passed.isEmpty():
            break
        now = passed.select(
            *[c for c in now.columns if c not in ("date", "is_resistance", "internal_margin", "external_margin", "flips",
                                                  "return_end_time")],
            F.col("passing_time").alias("date"),
            (~F.col("is_resistance")).alias("is_resistance"),
            F.col("external_margin").alias("internal_margin"),
            F.col("internal_margin").alias("external_margin"),
            F.col("passing_time").alias("return_end_time"),
            (F.col("flips") + 1).alias("flips"),
        )
    out = rounds[0]
    for other in rounds[1:]:
        out = out.unionByName(other)
    return out


def add_hits(pivots: DataFrame, candles: DataFrame, tf: str, hits: int = ACTIVE_HITS) -> DataFrame:
    """Ends of the hits: a hit starts when the price touches the inner margin and ends when it is off it again.

    Hit 0 only ends, the first bar after the pivot's return off the margin. Each later search starts on the bar
    after the one before; hits that start or end after the passing do not count.
    """
    kinds = F.array(
        F.struct(F.lit(True).alias("is_resistance"), F.col("high").alias("v")),
        F.struct(F.lit(False).alias("is_resistance"), (-F.col("low")).alias("v")),
    )
    sides = staged(candles.select(*SERIES, "date", F.explode(kinds).alias("_k")).select(*SERIES, "date", "_k.*"))
    margin = F.when(F.col("is_resistance"), F.col("internal_margin")).otherwise(-F.col("internal_margin"))

    def search(df: DataFrame, since: Column, comparator: str, out: str, limited: bool) -> DataFrame:
        # a bar later, and from there strictly later again
        df = first_crossing(
            staged(df), sides, margin, "v", comparator, TF_MINUTES[tf] * 60, by=PIVOT_SIDE,
            base_time=plus_seconds(since, minutes_of("timeframe") * 60),
        )
        hit = F.col("right_crossing_time")
        valid = hit if not limited else F.when(hit > F.col("passing_time"), F.lit(None)).otherwise(hit)
        return df.withColumn(out, valid).drop("right_crossing_time", "right_crossing_value")

    out = search(pivots, F.greatest("return_end_time", "date"), "lt", "hit_end_0", False)
    hit = F.lit(0)
    for n in range(1, hits + 1):
        out = search(out, F.col(f"hit_end_{n - 1}"), "ge", f"hit_start_{n}", True)
        out = search(out, F.col(f"hit_start_{n}"), "lt", f"hit_end_{n}", True)
        hit = F.when(F.col(f"hit_end_{n}").isNotNull(), n + 1).otherwise(hit)
    return out.withColumn("hit", hit)


def deactivate(pivots: DataFrame, candles: DataFrame, hits: int = ACTIVE_HITS) -> DataFrame:
    """When a pivot ends: at its last allowed hit, else at its passing, and at its `ttl` at the latest."""
    last = candles.groupBy(*SERIES).agg(F.max("date").alias("_last"))
    passed = F.when(F.col("passing_time") < F.col("ttl"), F.col("passing_time"))
    ended = F.coalesce(F.col(f"hit_end_{hits}"), passed)
    expired = F.when(F.col("ttl") < F.col("_last"), F.col("ttl"))
    return (
        pivots.join(last, list(SERIES))
        .withColumn("deactivated_at", F.coalesce(F.least(ended, F.when(ended.isNotNull(), F.col("ttl"))), expired))
        .drop("_last")
    )


def pivot_life(pivots: DataFrame, candles: DataFrame, tf: str, hits: int = ACTIVE_HITS) -> DataFrame:
    """Passing with flips, hits, and the end of each pivot on the candles of its own timeframe."""
    return deactivate(add_hits(flip_on_passing(pivots, candles, tf), candles, tf, hits), candles, hits)
