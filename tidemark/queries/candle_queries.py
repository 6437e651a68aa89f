"""Candles: resampling, gap filling, weekly and monthly bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.resample import resample, ticks_to_candles
from tidemark.queries import query
from tidemark.queries.views import (
    LADDER,
    candles,
    r6,
    raw_candles,
    s6,
    sql_candles,
    sql_stacked,
    stacked,
    ticks,
)

OHLC = ["open", "high", "low", "close"]


def _shown(df):
    return df.select("symbol", "timeframe", "date", *OHLC, r6("volume").alias("volume"))


@query("candle_resample", f"""WITH {sql_candles("1h")}
SELECT symbol, '1h' AS timeframe, date, open, high, low, close, {s6("volume", "volume")} FROM raw_1h""")
def candle_resample(spark, sf):
    return _shown(raw_candles(spark, sf))


@query("candle_fill", f"""WITH {sql_candles("1h")}
SELECT symbol, timeframe, date, open, high, low, close, {s6("volume", "volume")} FROM c_1h""")
def candle_fill(spark, sf):
    return _shown(candles(spark, sf))


@query("candle_ladder", f"""WITH {sql_stacked()}
SELECT symbol, timeframe, date, open, high, low, close, {s6("volume", "volume")} FROM mt""")
def candle_ladder_query(spark, sf):
    return _shown(stacked(spark, sf))
