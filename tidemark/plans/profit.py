"""Profit and loss labels of a delayed entry over a horizon."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.functions.ladder import TF_MINUTES
from tidemark.operators.blocks import BLOCK_BARS, framed
from tidemark.operators.smoothing import add_atr
from tidemark.operators.windows import frame_argmax, frame_argmin, frame_array, frame_max, frame_min, full, tops_mean


def _whole(value: Column, w: WindowSpec, first: int, last: int) -> Column:
    return F.when(full(F.col("high"), w, first, last), value)


def add_horizon_extremes(df: DataFrame, horizon: int, delay: int, window: int) -> DataFrame:
    """Worst entry inside the delay; extremes of the `window` bars that end `horizon` bars ahead, and how far."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        first, last = horizon - window + 1, horizon
        return rows.withColumns(
            {
                "worst_long_open": _whole(frame_max("high", w, 0, delay - 1), w, 0, delay - 1),
                "worst_short_open": _whole(frame_min("low", w, 0, delay - 1), w, 0, delay - 1),
                "max_high": _whole(frame_max("high", w, first, last), w, first, last),
                "min_low": _whole(frame_min("low", w, first, last), w, first, last),
                "max_high_distance": _whole(frame_argmax("high", w, first, last) + F.lit(float(delay)), w, first, last),
                "min_low_distance": _whole(frame_argmin("low", w, first, last) + F.lit(float(delay)), w, first, last),
            }
        )

    return framed(df, build, after=horizon, size=max(BLOCK_BARS, 4 * horizon))


def add_sub_horizons(df: DataFrame, window: int, quantiles: int) -> DataFrame:
    """Extremes of the next `i/quantiles` of the window, i = 1 … quantiles, as `q<i>_…` columns.

    The window is cut into its steps; each step has frames of its own, short ones, and a running fold over the steps gives the
    extremes from the first step on. A later step only counts if it is more extreme.
    """
    ends = [int(i * window / quantiles) for i in range(quantiles + 1)]

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        kinds = {"max_high": ("high", frame_max, frame_argmax, 1), "min_low": ("low", frame_min, frame_argmin, -1)}
        arrays = {"_ahead": F.count("high").over(w.rowsBetween(1, window))}
        for name, (c, extreme, place, sign) in kinds.items():
            steps = [
                F.struct((extreme(c, w, a + 1, b) * sign).cast("double").alias("v"), (place(c, w, a + 1, b) + a).cast("double").alias("at"))
                if a < b else F.struct(F.lit(None).cast("double").alias("v"), F.lit(None).cast("double").alias("at"))
                for a, b in zip(ends, ends[1:], strict=False)
            ]
            arrays[f"_{name}"] = F.array(*steps)
        rows = rows.withColumns(arrays)

        def running(steps: str) -> Column:
            first = F.array().cast("array<struct<v:double,at:double>>")

            def fold(done: Column, s: Column) -> Column:
                last = F.try_element_at(done, F.lit(-1))
                better = last["v"].isNull() | (s["v"] > last["v"])
                return F.concat(done, F.array(F.when(better, s).otherwise(last)))

            return F.aggregate(steps, first, fold)

        rows = rows.withColumns({f"_{name}": running(f"_{name}") for name in kinds})
        new = {}
        for i in range(1, quantiles + 1):
            there = F.col("_ahead") >= ends[i]
            for name, (_, _, _, sign) in kinds.items():
                best = F.col(f"_{name}")[i - 1]
                new[f"q{i}_{name}"] = F.when(there, best["v"] * sign)
                new[f"q{i}_{name}_distance"] = F.when(there, best["at"])
        return rows.withColumns(new).drop("_ahead", *[f"_{name}" for name in kinds])

    return framed(df, build, after=window, size=max(BLOCK_BARS, 4 * window))


def add_drawdowns(df: DataFrame, horizon: int, quantiles: int) -> DataFrame:
    """Adverse extreme of the sub-horizon in which the best price falls, as distance from the worst entry."""
    step = horizon / quantiles
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()

    def picked(prefix: str, at: str) -> Column:
        values = F.array(*[F.col(f"q{i}_{prefix}") for i in range(1, quantiles + 1)])
        return F.when(F.col(at).isNotNull(), F.try_element_at(values, F.col(at).cast("int") + 1))

    out = df.withColumn("_complete", complete).withColumns(
        {
            "max_high_quantile": F.when(F.col("_complete"), F.col("max_high_distance") / step),
            "min_low_quantile": F.when(F.col("_complete"), F.col("min_low_distance") / step),
        }
    )
    out = out.withColumns(
        {
            "quantile_long_min_low": picked("min_low", "max_high_quantile"),
            "quantile_short_max_high": picked("max_high", "min_low_quantile"),
        }
    )
    out = out.withColumns(
        {
            "absolute_long_drawdown": F.col("worst_long_open") - F.col("quantile_long_min_low"),
            "absolute_short_drawdown": F.col("quantile_short_max_high") - F.col("worst_short_open"),
        }
    )
    return out.withColumns(
        {
            "long_drawdown": F.try_divide("absolute_long_drawdown", "atr"),
            "short_drawdown": F.try_divide("absolute_short_drawdown", "atr"),
        }
    ).drop("_complete")


def add_stop_distance(df: DataFrame) -> DataFrame:
    """Drawdown, at least one ATR."""

    def at_least_one(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(1.0), F.col(c)))

    return df.withColumns(
        {"long_sl_distance": at_least_one("long_drawdown"), "short_sl_distance": at_least_one("short_drawdown")}
    )


def add_profit(df: DataFrame, bar_rate: float, order_fee: float, max_risk: float) -> DataFrame:
    """Profit after holding cost and fee, risk against it, and the signal; losing sides get risk 1 and signal 0."""
    out = df.withColumns(
        {
            "long_profit": F.col("max_high") - F.col("worst_long_open"),
            "short_profit": F.col("worst_short_open") - F.col("min_low"),
        }
    )
    for side, distance in (("long", "max_high_distance"), ("short", "min_low_distance")):
        net = F.try_divide(f"{side}_profit", "atr") - F.col(distance) * bar_rate - order_fee
        out = out.withColumn(f"weighted_{side}_profit", net)
        out = out.withColumn("_risk", F.try_divide(f"{side}_drawdown", f"weighted_{side}_profit"))
        lost = F.coalesce((F.col(f"weighted_{side}_profit") <= 0) | (F.col("_risk") > max_risk), F.lit(False))
        out = out.withColumn(f"{side}_risk", F.when(lost, 1.0).otherwise(F.col("_risk")))
        strength = (1 - F.coalesce(f"{side}_risk", F.lit(1.0))) * F.try_divide(
            F.coalesce(f"weighted_{side}_profit", F.lit(0.0)), F.col(f"{side}_sl_distance")
        )
        out = out.withColumn(f"{side}_signal", F.when(lost, 0.0).otherwise(strength)).drop("_risk")
    return out


def drop_sub_horizons(df: DataFrame) -> DataFrame:
    """Leave out the `q<digits>_…` columns."""
    return df.drop(*[c for c in df.columns if re.match(r"q\d+_", c)])


def add_long_short_profit(
    df: DataFrame,
    horizon: int = 768,
    delay: int = 2,
    daily_rate: float = 0.10 / 365,
    order_fee: float = 0.005,
    quantiles: int = 50,
    max_risk: float = 0.1,
    trigger_tf: str = "15min",
) -> DataFrame:
    """The whole chain."""
    window = horizon - delay
    if "atr" not in df.columns:
        df = add_atr(df, 256)
    out = add_horizon_extremes(df, horizon, delay, window)
    width = TF_MINUTES[trigger_tf]
    out = out.withColumns(
        {
            "long_distance_minutes": F.col("max_high_distance") * width,
            "short_distance_minutes": F.col("min_low_distance") * width,
        }
    )
    out = add_stop_distance(add_drawdowns(add_sub_horizons(out, window, quantiles), horizon, quantiles))
    return drop_sub_horizons(add_profit(out, daily_rate / (1440 / width), order_fee, max_risk))


def add_tops_stop_loss(df: DataFrame, window: int, percent: float, atr_distance: float = 2.0) -> DataFrame:
    """Stop at the mean of the extreme lows (highs), moved to `atr_distance` ATRs when it is nearer than that."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns(
            {
                "_low": tops_mean("low", w, window, percent, largest=False),
                "_high": tops_mean("high", w, window, percent, largest=True),
            }
        )

    room = F.col("atr") * atr_distance
    out = framed(df, build, before=window - 1)
    return out.withColumns(
        {
            "long_sl": F.when(F.abs(F.col("_low") - F.col("low")) < room, F.col("low") - room).otherwise(F.col("_low")),
            "short_sl": F.when(F.abs(F.col("_high") - F.col("high")) < room, F.col("high") + room).otherwise(
                F.col("_high")
            ),
        }
    ).drop("_low", "_high")


def add_step_drawdowns(df: DataFrame, window: int) -> DataFrame:
    """Falls from each bar's high to the next low on the way to the best high, and the mirror for shorts.

    The way to an extreme `d` bars ahead has the `d` bars from this one on. Steps that do not fall count as zero
    but are counted. The relative drawdown shrinks with the length of the way; power is profit less that.
    """

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumns(
            {
                "_fall": F.greatest(F.lit(0.0), F.col("high") - F.lead("low").over(w)),
                "_rise": F.greatest(F.lit(0.0), F.lead("high").over(w) - F.col("low")),
            }
        )
        return rows.withColumns(
            {
                "long_profit": _whole(frame_max("high", w, 1, window) - F.col("high"), w, 1, window),
                "short_profit": _whole(F.col("low") - frame_min("low", w, 1, window), w, 1, window),
                "count_long_drawdown": _whole(frame_argmax("high", w, 1, window), w, 1, window),
                "count_short_drawdown": _whole(frame_argmin("low", w, 1, window), w, 1, window),
                "_falls": frame_array("_fall", w, 0, window - 1),
                "_rises": frame_array("_rise", w, 0, window - 1),
            }
        ).where("count_long_drawdown is not null")

    def total(steps: str, n: str) -> Column:
        way = F.slice(steps, F.lit(1), F.col(n).cast("int"))
        return F.aggregate(way, F.lit(0.0), lambda a, x: a + x)

    out = framed(df, build, after=window + 1, size=max(BLOCK_BARS, 4 * window))
    for side, steps in (("long", "_falls"), ("short", "_rises")):
        out = out.withColumn(f"max_{side}_drawdown", total(steps, f"count_{side}_drawdown"))
        share = F.lit(1.0) - F.col(f"count_{side}_drawdown") / window
        out = out.withColumn(f"relative_{side}_drawdown", share * F.col(f"max_{side}_drawdown"))
        out = out.withColumn(
            f"effective_{side}_power", F.col(f"{side}_profit") - F.col(f"relative_{side}_drawdown")
        )
    return out.drop("_fall", "_rise", "_falls", "_rises")
