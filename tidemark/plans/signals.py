"""Signals from activated bases, and what is alive at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.operators.blocks import framed
from tidemark.operators.ranges import interval_join

# Order prices and the fee rule.
LIMIT_MARGIN, REWARD_RATE, FEE_SAFETY = 0.05, 5.0, 3.0
INITIAL_CASH, RISK_PER_ORDER = 1000.0, 0.01


def reasonable_fee(limit: Column, take_profit: Column, commission: float) -> Column:
    """The way to the target is not shorter than the safe multiple of the average cost of a trade."""
    cost = (REWARD_RATE + 1) * commission * limit
    return F.abs(take_profit - limit) >= cost * FEE_SAFETY


def effective_end() -> Column:
    return F.least("end", "ttl")


def extract_signals(bases: DataFrame, commission: float = 0.001) -> DataFrame:
    """One signal per activated band: at the activation, if the base is older than it and still alive then.

    Upper bands buy above the base with the stop at its low, lower bands sell below it with the stop at its high.
    """
    bands = F.array(
        F.struct(F.lit("upper").alias("band"), F.lit("buy").alias("side"), F.lit(1.0).alias("sign"),
                 F.col("internal_high").alias("near"), F.col("internal_low").alias("far"),
                 F.col("upper_band_activated").alias("date")),
        F.struct(F.lit("below").alias("band"), F.lit("sell").alias("side"), F.lit(-1.0).alias("sign"),
                 F.col("internal_low").alias("near"), F.col("internal_high").alias("far"),
                 F.col("below_band_activated").alias("date")),
    )
    rows = bases.withColumn("_b", F.explode(bands)).where("_b.date is not null")
    alive = (F.col("date") < F.col("_b.date")) & (effective_end() > F.col("_b.date"))
    size = F.col("internal_high") - F.col("internal_low")
    out = rows.where(alive).select(
        "symbol",
        F.col("_b.date").alias("date"),
        F.col("date").alias("ref_date"),
        F.col("timeframe").alias("ref_timeframe"),
        F.col("_b.side").alias("side"),
        F.coalesce("end", "ttl").alias("end"),
        (F.col("_b.near") + F.col("_b.sign") * F.col("atr") * LIMIT_MARGIN).alias("limit_price"),
        F.col("_b.far").alias("stop_loss"),
        (F.col("_b.near") + F.col("_b.sign") * size * REWARD_RATE).alias("take_profit"),
        F.col("_b.near").alias("trigger_price"),
    )
    return out.where(reasonable_fee(F.col("limit_price"), F.col("take_profit"), commission))


def active_signals(candles: DataFrame, signals: DataFrame, payload: list[str], bucket_s: int) -> DataFrame:
    """The signals alive at each candle: from their date until before their end."""
    return interval_join(
        candles, signals, ["symbol"], "date", "date", "end", bucket_s, payload, include_end=False
    )


def execution_type() -> Column:
    """Kind of order the prices of a signal ask for."""
    trigger, limit, stop = F.col("trigger_price"), F.col("limit_price"), F.col("stop_loss")
    return (
        F.when(trigger.isNotNull() & limit.isNotNull(), "StopLimit")
        .when(stop.isNotNull(), "Stop")
        .when(limit.isNotNull(), "Limit")
        .when(trigger.isNull(), "Market")
        .otherwise("Custom")
    )


def add_risk_size(signals: DataFrame, cash: float = INITIAL_CASH, risk: float = RISK_PER_ORDER) -> DataFrame:
    """Position size that risks a share of the cash between limit and stop, and the money so risked."""
    gap = F.abs(F.col("stop_loss") - F.col("limit_price"))
    out = signals.withColumn("size", F.try_divide(F.lit(cash * risk), gap))
    return out.withColumn("risked_money", F.col("size") * gap)


def add_movement_overlap(candles: DataFrame, low: float | str, high: float | str) -> DataFrame:
    """What the last two candles together share with a price band, 0 where they share nothing."""

    def as_column(x) -> Column:
        return F.col(x) if isinstance(x, str) else F.lit(x)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        top = F.least(F.greatest("high", F.lag("high").over(w)), as_column(high))
        bottom = F.greatest(F.least("low", F.lag("low").over(w)), as_column(low))
        return rows.withColumn("movement_overlap", F.greatest(F.lit(0.0), top - bottom))

    return framed(candles, build, before=1)
