"""Ticks to candles, candles to higher timeframes, empty bins to flat candles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.clock import epoch_us
from tidemark.functions.ladder import bar_of, start_of_bar
from tidemark.operators.blocks import BLOCK_BARS
from tidemark.session import staged

OHLCV = ["open", "high", "low", "close", "volume"]


def order_key(ticks: DataFrame, order: Sequence[str]) -> Column:
    """The order of ticks as one value of fixed width, so that first and last prices aggregate by hash, without a sort.

    A time and a whole number become one decimal: 18 digits of microseconds (years 1 to 9999), 20 digits of number.
    """
    kinds = [ticks.schema[c].dataType.typeName() for c in order]
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and kinds[0].startswith("timestamp") and kinds[1] in ("long", "integer", "short", "byte"):
        number = F.col(order[1]).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        return epoch_us(order[0]).cast("decimal(18,0)") * F.lit(str(10**20)).cast("decimal(21,0)") + number
    return F.struct(*order)


def ticks_to_candles(ticks: DataFrame, tf: str, order: Sequence[str] = ("date",)) -> DataFrame:
    """Ticks `(symbol, date, price, volume)` to candles of one timeframe; `order` is a full order of the ticks."""
    key = order_key(ticks, order)
    return (
        ticks.withColumn("bar", bar_of("date", tf))
        .groupBy("symbol", "bar")
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.lit(tf).alias("timeframe"), "bar", start_of_bar("bar", tf).alias("date"), *OHLCV)
    )


def _bars(tf: str, week_close_label: bool) -> Column:
    """The bar of a base candle; with `week_close_label` weeks run Tuesday to Monday, named by that Monday."""
    if tf == "1W" and week_close_label:
        return bar_of(F.col("date") + F.expr("INTERVAL '6' DAY"), tf)
    return bar_of("date", tf)


def resample(candles: DataFrame, timeframes: Sequence[str], week_close_label: bool = False) -> DataFrame:
    """One base timeframe to several higher ones, stacked. One shuffle for all of them, with partial sums."""
    targets = F.explode(
        F.array(*[F.struct(F.lit(tf).alias("timeframe"), _bars(tf, week_close_label).alias("bar")) for tf in timeframes])
    )
    grouped = (
        candles.select("symbol", "date", *OHLCV, targets.alias("_to"))
        .select("symbol", "_to.timeframe", "_to.bar", "date", *OHLCV)
        .groupBy("symbol", "timeframe", "bar")
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )
    return grouped.select("symbol", "timeframe", "bar", _date_of_bar(timeframes).alias("date"), *OHLCV)


def _date_of_bar(timeframes: Sequence[str]) -> Column:
    date = F.lit(None).cast("timestamp_ntz")
    for tf in timeframes:
        date = F.when(F.col("timeframe") == tf, start_of_bar("bar", tf)).otherwise(date)
    return date


def fill_empty_bins(candles: DataFrame, timeframes: Sequence[str], size: int = BLOCK_BARS) -> DataFrame:
    """Give every empty bin between the first and the last candle a flat zero-volume candle at the last close.

    Each candle produces the empty bins that follow it, so no grid is built and joined. The next candle is looked
    up inside a block of bars, and across blocks from the first bar of the next block that has any.
    """
    keys = ["symbol", "timeframe"]
    cut = candles.withColumn("_block", F.floor(F.col("bar") / size).cast("long"))
    later = Window.partitionBy(*keys).orderBy("_block")
    first_of_next = (
        cut.groupBy(*keys, "_block")
        .agg(F.min("bar").alias("_first"))
        .select(*keys, "_block", F.lead("_first").over(later).alias("_across"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("bar")
    following = F.coalesce(F.lead("bar").over(inside), F.col("_across"), F.col("bar") + 1)
    spread = (
        cut.join(first_of_next, [*keys, "_block"])
        .withColumn("_next", following)
        # block by block, so that a gap of years is never one array
        .withColumn("_part", F.explode(F.sequence(F.col("_block"), F.floor((F.col("_next") - 1) / size).cast("long"))))
        .withColumn(
            "_bin",
            F.explode(
                F.sequence(F.greatest("bar", F.col("_part") * size), F.least(F.col("_next"), (F.col("_part") + 1) * size) - 1)
            ),
        )
    )
    real = F.col("_bin") == F.col("bar")
    return spread.select(
        *keys,
        F.col("_bin").alias("bar"),
        *[F.when(real, F.col(c)).otherwise(F.col("close")).alias(c) for c in ("open", "high", "low")],
        "close",
        F.when(real, F.col("volume")).otherwise(F.lit(0.0)).alias("volume"),
    ).select(*keys, "bar", _date_of_bar(timeframes).alias("date"), *OHLCV)


def candle_ladder(base: DataFrame, base_tf: str, higher: Sequence[str], week_close_label: bool = False) -> DataFrame:
    """The stacked table: filled base candles and filled higher timeframes."""
    filled = staged(fill_empty_bins(base, [base_tf]))
    upper = fill_empty_bins(resample(filled, higher, week_close_label), higher)
    return filled.unionByName(upper)
