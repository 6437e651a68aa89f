"""Samples with random ends: four consecutive slices on four timeframes, scaled, balanced by what could be acted on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.clock import DAY_S, epoch_s, from_epoch_s, minutes_between, plus_seconds
from tidemark.functions.ladder import TF_MINUTES, bar_of, floor_to_bar
from tidemark.functions.scalars import drawn
from tidemark.operators.indicators import add_classic_indicators
from tidemark.operators.validate import common_complete_range
from tidemark.plans.features import add_relative_candle, add_volume_rma
from tidemark.session import staged
from tidemark.sources.manifest import cache_gaps

# Columns scaled as prices, those without scale, and the scaling constants.
PRICES = ["open", "high", "low", "close", "bbands_u", "bbands_m", "bbands_l", "ichi_conv", "ichi_base", "ichi_lead_a",
          "ichi_lead_b", "ichi_lag", "min_low", "max_high", "worst_long_open", "worst_short_open", "quantile_long_min_low",
          "quantile_short_max_high"]
# The label columns of a sample, in their order; the drawdowns stand there twice.
LABELS = ["long_signal", "short_signal", "min_low", "max_high", "long_profit", "short_profit", "long_risk", "short_risk",
          "long_drawdown", "short_drawdown"]
LABEL_ORDER = [*range(10), 8, 9]
SCALE_SHARE, CENTRE, SPREAD = 1 / 20, 50.0, 8.0


@dataclass(frozen=True)
class Level:
    """One slice of a sample: its timeframe and how many bars it has."""

    name: str
    timeframe: str
    bars: int


def frame_with_indicators(candles: DataFrame, atr_length: int = 256) -> DataFrame:
    """Candles of one timeframe with classic indicators, candle ratios and the volume ratio."""
    return add_volume_rma(add_relative_candle(add_classic_indicators(candles), atr_length))


def sample_ends(bounds: DataFrame, levels: Sequence[Level], draws: int, seed: int) -> DataFrame:
    """Random ends of the first level in each symbol's safe range `(symbol, start, end)`, draws 1, 2, …, and the ends of the levels
    before it: each slice ends where the next one starts. The same seed draws the same ends."""
    length = sum(TF_MINUTES[v.timeframe] * 60 * v.bars for v in levels)
    rows = bounds.withColumns(
        {"_room": epoch_s("end") - epoch_s("start") - length, "draw": F.explode(F.sequence(F.lit(1), F.lit(draws)))}
    ).where("_room > 0")
    back = drawn("symbol", "draw", F.lit(seed)) % F.col("_room")
    out = rows.withColumn(f"end_{levels[0].name}", from_epoch_s(epoch_s("end") - back))
    for near, far in zip(levels, levels[1:], strict=False):
        out = out.withColumn(
            f"end_{far.name}", plus_seconds(f"end_{near.name}", -TF_MINUTES[near.timeframe] * 60 * near.bars)
        )
    return out.drop("_room", "start", "end")


def _slice_rows(ends: DataFrame, frame: DataFrame, level: Level) -> DataFrame:
    """The bars of a level's slices, a row each: ends carry (symbol, draw, end_<level>), frames are met by bar."""
    last = bar_of(f"end_{level.name}", level.timeframe)
    asked = ends.select("symbol", "draw", F.explode(F.sequence(last - (level.bars - 1), last)).alias("bar"))
    return asked.join(frame, ["symbol", "bar"])


def whole_slices(ends: DataFrame, frames: dict[str, DataFrame], levels: Sequence[Level], columns: Sequence[str], max_gap: int) -> DataFrame:
    """The draws of `ends` all of whose slices have their bars, complete and without a gap of more than `max_gap` bars."""
    out = ends
    for v in levels:
        rows = _slice_rows(ends, frames[v.name].dropna(subset=[*columns, "atr"]).select("symbol", "bar", "date"), v)
        span = minutes_between(F.max("date"), F.min("date")) / TF_MINUTES[v.timeframe]
        good = rows.groupBy("symbol", "draw").agg(F.count(F.lit(1)).alias("_n"), span.alias("_span")).where(
            (F.col("_n") == v.bars) & (F.abs(F.col("_span") - (v.bars - 1)) <= max_gap))
        out = out.join(good.select("symbol", "draw"), ["symbol", "draw"], "left_semi")
    return out


def accepted_draws(draws: DataFrame, count: int, actionable_rate: float) -> DataFrame:
    """The first `count` draws of each symbol that are taken, in order: one without a signal is passed over while there is no
    sample with a signal yet, or more than 1/rate - 1 without for each with one. `draws`: (symbol, draw, is_actionable)."""

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows, yes, no, kept = rows.sort_values("draw"), 0, 0, []
        for draw, actionable in zip(rows["draw"], rows["is_actionable"], strict=True):
            if len(kept) == count:
                break
            if actionable or (yes and no / yes <= 1 / actionable_rate - 1):
                yes, no = yes + bool(actionable), no + (not actionable)
                kept.append(draw)
        return pd.DataFrame({"symbol": rows["symbol"].iloc[: len(kept)], "draw": kept})

    # a symbol's draws: a number each, as many as were asked for
    return draws.select("symbol", "draw", "is_actionable").groupBy("symbol").applyInPandas(take, "symbol string, draw int")


def _scaled(x: Column, columns: Sequence[str]) -> Column:
    """A bar's columns on the sample's scale; missing label values stay NULL."""
    values = []
    for c in columns:
        if c in PRICES:
            v = (x[c] + F.col("price_shift")) * F.col("price_scale") * SCALE_SHARE
        elif "_profit" in c or "_drawdown" in c:
            v = x[c] * F.col("price_scale") * SCALE_SHARE
        elif c == "volume":
            v = x[c] * F.col("volume_scale")
        elif c in ("rsi", "mfi"):
            v = (x[c] - CENTRE) / SPREAD
        else:
            v = x[c]
        values.append(v.cast("float"))
    return F.array(*values)


def add_scales(samples: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """Per sample 1 / mean ATR of the trigger slice, minus the last close, and 1 / mean volume of all slices."""
    first = levels[0].name

    def total(name: str, c: str) -> Column:
        return F.aggregate(name, F.lit(0.0), lambda a, x: a + x[c])

    bars = sum(v.bars for v in levels)
    volume = sum((total(v.name, "volume") for v in levels), F.lit(0.0))
    return samples.withColumns(
        {
            "price_scale": F.try_divide(F.lit(float(levels[1].bars)), total(levels[1].name, "atr")),
            "price_shift": -F.element_at(first, -1)["close"],
            "volume_scale": F.try_divide(F.lit(float(bars)), volume),
        }
    )


def scale_parameters(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same three scales for groups of rows in long form: `(keys, price_scale, price_shift, volume_scale)`."""
    return frame.groupBy(*keys).agg(
        F.try_divide(F.lit(1.0), F.avg("atr")).alias("price_scale"),
        (-F.max_by("close", "date")).alias("price_shift"),
        F.try_divide(F.lit(1.0), F.avg("volume")).alias("volume_scale"),
    )


def random_samples(
    frames: dict[str, DataFrame], labels: DataFrame, levels: Sequence[Level], columns: Sequence[str], per_symbol: int,
    seed: int, label_tf: str, forecast_bars: int, actionable_rate: float = 0.2, max_gap: int = 1, most_draws: int = 1 << 16,
) -> DataFrame:
    """`per_symbol` samples of each symbol: a scaled array per level, the signals at its end, the scales, and `future`, the label columns
    of the next `forecast_bars` bars on the same scale.

    `frames[level]` has `columns` and `atr`; `labels` has `LABELS` on `label_tf`. The ends lie where every frame is complete and the
    forecast still has its bars. `levels` run from the last slice back. Draws are made in order and passed over as `accepted_draws`
    says, twice as many in each round until every symbol has its number; a symbol that still has fewer after `most_draws` keeps those.
    """
    complete = {v.name: frames[v.name].select("symbol", "date", *columns) for v in levels}
    complete["labels"] = labels.select("symbol", "date", "long_signal", "short_signal")
    bounds = common_complete_range(complete)
    first_bar, ahead = TF_MINUTES[levels[-1].timeframe] * 60, 2 * forecast_bars * TF_MINUTES[label_tf] * 60
    bounds = staged(bounds.withColumns({"start": plus_seconds("start", first_bar), "end": plus_seconds("end", -ahead)}))
    # the first label at or after the end
    at = bar_of(plus_seconds(f"end_{levels[0].name}", -1), label_tf) + 1
    signals = labels.select("symbol", F.col("bar").alias("_at"), "long_signal", "short_signal")
    draws = 2 * per_symbol
    while True:
        ends = sample_ends(bounds, levels, draws, seed).withColumn("_at", at).join(signals, ["symbol", "_at"])
        signal = F.coalesce((F.col("long_signal") != 0) | (F.col("short_signal") != 0), F.lit(False))
        ends = staged(ends.withColumn("is_actionable", signal))
        taken = staged(accepted_draws(whole_slices(ends, frames, levels, columns, max_gap), per_symbol, actionable_rate))
        wanting = bounds.join(taken.groupBy("symbol").count().where(F.col("count") >= per_symbol), "symbol", "left_anti")
        if draws >= most_draws or wanting.isEmpty():
            break
        draws *= 2
    out = staged(ends.join(taken, ["symbol", "draw"]))

    def gathered(rows: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
        return rows.groupBy("symbol", "draw").agg(F.sort_array(F.collect_list(F.struct("date", *values))).alias(name))

    parts = [gathered(_slice_rows(out, frames[v.name].select("symbol", "bar", "date", *columns, "atr"), v), v.name, [*columns, "atr"]) for v in levels]
    coming = out.select("symbol", "draw", F.explode(F.sequence(F.col("_at"), F.col("_at") + (forecast_bars - 1))).alias("bar"))
    parts.append(gathered(coming.join(labels.select("symbol", "bar", "date", *LABELS), ["symbol", "bar"]), "future", LABELS))
    for part in parts:
        out = out.join(part, ["symbol", "draw"])
    out = add_scales(staged(out.drop("_at")), levels)
    scaled = {v.name: F.transform(v.name, lambda x: _scaled(x, columns)) for v in levels}
    return out.withColumns({**scaled, "future": F.transform("future", lambda x: _scaled(x, [LABELS[i] for i in LABEL_ORDER]))})


def overlapped_periods(ranges: DataFrame, length_days: int = 90, slide_days: int = 45) -> DataFrame:
    """Periods of fixed length that start every `slide_days` days, counted from the start of the year, inside a range.

    The first start is the first such day at or after the range's start.
    """
    day = floor_to_bar(plus_seconds("start", DAY_S - 1), "1D")
    year = F.date_trunc("year", day).cast("timestamp_ntz")
    days = F.floor((epoch_s(day) - epoch_s(year)) / DAY_S)
    first = plus_seconds(year, F.ceil(days / slide_days) * slide_days * DAY_S)
    last = plus_seconds("end", -length_days * DAY_S)
    starts = F.sequence(epoch_s(first), epoch_s(last), F.lit(slide_days * DAY_S))
    rows = ranges.withColumn("_starts", F.when(first <= last, starts)).withColumn("_s", F.explode("_starts"))
    return rows.drop("_starts").withColumns(
        {"period_start": from_epoch_s("_s"), "period_end": from_epoch_s(F.col("_s") + length_days * DAY_S)}
    ).drop("_s")


def random_periods(summary: DataFrame, days: int, seed: int) -> DataFrame:
    """A seeded period of `days` days, on a whole hour of each symbol's stored span; spans too short give none."""
    room = F.floor((epoch_s("end") - epoch_s("start") - days * DAY_S) / 3600)
    hours = drawn("symbol", F.lit(seed)) % (room + 1)
    start = plus_seconds("start", hours * 3600)
    return summary.where(room >= 0).select(
        "symbol", start.alias("period_start"), plus_seconds(start, days * DAY_S).alias("period_end")
    )


def range_for_now(now: Column, weeks: int = 140, ahead_minutes: int = 300) -> tuple[Column, Column]:
    """The range a sample at `now` needs: the longest look-back and the label horizon."""
    return plus_seconds(now, -weeks * 7 * DAY_S), plus_seconds(now, ahead_minutes * 60)


def gaps_for_now(manifest: DataFrame, nows: DataFrame, freq: str = "D", weeks: int = 140, ahead_minutes: int = 300) -> DataFrame:
    """What a sample at each symbol's `now` lacks: closed windows of the range it needs that nothing stored covers, neighbours
    merged: `(symbol, start, end, windows)`. `manifest` lists the stored files, `nows` is `(symbol, now)`."""
    start, end = range_for_now(F.col("now"), weeks, ahead_minutes)
    asked = nows.select("symbol", start.alias("start"), end.alias("end"))
    latest = nows.agg(F.max("now")).first()[0]  # one moment: windows that end after it are open
    return cache_gaps(asked, manifest, freq, F.lit(latest).cast("timestamp_ntz"))


def reconstruct_forecast(forecasts: DataFrame, divisor: float = 256.0) -> DataFrame:
    """Highs and lows from forecast steps in deviations.

    `forecasts`: one row per forecast with the last known `high, low, mean_high, mean_low, std_high, std_low` and
    `steps`, an array of `(step, n_high, n_low)`. Each step is read against the mean and deviation of the one
    before, which then take it in with weight 1/`divisor`. Returns a row per step.
    """
    keep = divisor - 1
    fields = ["high", "low", "mean_high", "mean_low", "std_high", "std_low"]
    start = F.array(F.struct(*[F.col(c).cast("double").alias(c) for c in fields], F.lit(0).alias("step")))

    def step(path: Column, s: Column) -> Column:
        p = F.element_at(path, -1)
        values = {}
        for side in ("high", "low"):
            value = p[f"mean_{side}"] + p[f"std_{side}"] * s[f"n_{side}"]
            mean = (p[f"mean_{side}"] * keep + value) / divisor
            spread = F.sqrt((keep * p[f"std_{side}"] * p[f"std_{side}"] + (value - mean) * (value - mean)) / divisor)
            values |= {side: value, f"mean_{side}": mean, f"std_{side}": spread}
        row = F.struct(*[values[c].alias(c) for c in fields], s["step"].cast("int").alias("step"))
        return F.concat(path, F.array(row))

    path = F.aggregate(F.array_sort("steps"), start, step)
    rest = [c for c in forecasts.columns if c not in (*fields, "steps")]
    return forecasts.select(*rest, F.explode(path).alias("_s")).select(*rest, "_s.*")
