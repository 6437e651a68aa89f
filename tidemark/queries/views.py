"""The series the queries run on, built from the given tables, and the same series as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.ladder import floor_to_bar
from tidemark.operators.resample import candle_ladder, fill_empty_bins, ticks_to_candles

HIGHER = ["4h", "1D", "1W"]
LADDER = ["1h", *HIGHER]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as ticks: the event type is the symbol, the value is price and volume."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        ntz("ts").alias("date"),
        F.col("value").alias("price"),
        F.col("value").alias("volume"),
        F.col("event_id").alias("seq"),
    )


def raw_candles(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    return ticks_to_candles(ticks(spark, sf_dir), tf, ("date", "seq"))


def candles(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    """Gap-free candles of one timeframe."""
    return fill_empty_bins(raw_candles(spark, sf_dir, tf), [tf])


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free candles of 1h, 4h, 1D and 1W in one table."""
    return candle_ladder(raw_candles(spark, sf_dir), "1h", HIGHER)


def daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as daily candles: the priority is the symbol, prices follow the order key inside a day."""
    prices = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        ntz("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("volume"),
        F.col("o_orderkey").alias("seq"),
    )
    return ticks_to_candles(prices, "1D", ("date", "seq"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_empty_bins(daily_raw(spark, sf_dir), ["1D"])


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as daily sums per return flag; only order-free folds, the rows of a day have no order."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("symbol"), floor_to_bar(ntz("l_shipdate"), "1D").alias("date"))
        .agg(
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def r6(c: Column | str) -> Column:
    """Six digits: far above the noise of sums taken in another order. Adding zero drops a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# --- the same series as SQL ------------------------------------------------------------------------------

_BUCKET = {"5min": "5 MINUTE", "15min": "15 MINUTE", "1h": "1 HOUR", "4h": "4 HOUR", "1D": "1 DAY", "1W": "7 DAY"}
_MINUTES = {"5min": 5, "15min": 15, "1h": 60, "4h": 240, "1D": 1440, "1W": 10080}


def s6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0" + (f" AS {name}" if name else "")


def _ohlcv(source: str, order: str) -> str:
    return (
        f"first(open ORDER BY {order}) AS open, max(high) AS high, min(low) AS low, "
        f"last(close ORDER BY {order}) AS close, sum(volume) AS volume FROM {source}"
    )


def _fill_sql(name: str, source: str, tf: str) -> str:
    step = _BUCKET[tf]
    return f"""
grid_{name} AS (
  SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL '{step}')) AS date FROM {source} GROUP BY symbol),
{name} AS (
  SELECT symbol, '{tf}' AS timeframe, date,
         coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close,
         coalesce(volume, 0.0) AS volume, CAST(floor((epoch(date) - {345600 if tf == '1W' else 0}) / {_MINUTES[tf] * 60}) AS BIGINT) AS bar
  FROM (SELECT g.symbol, g.date, r.open, r.high, r.low, r.volume,
               last_value(r.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date) AS c
        FROM grid_{name} g LEFT JOIN {source} r ON g.symbol = r.symbol AND g.date = r.date))"""


def sql_candles(tf: str = "1h") -> str:
    """CTEs `raw_<tf>` and `c_<tf>` over `events`."""
    return f"""
raw_{tf} AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '{_BUCKET[tf]}', ts) AS date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, sum(value) AS volume
  FROM events GROUP BY 1, 2),{_fill_sql("c_" + tf, "raw_" + tf, tf)}"""


def sql_stacked() -> str:
    """CTEs `c_1h`, `c_4h`, `c_1D`, `c_1W` and their union `mt`."""
    parts = [sql_candles("1h")]
    for tf in HIGHER:
        parts.append(f"""
up_{tf} AS (
  SELECT symbol, time_bucket(INTERVAL '{_BUCKET[tf]}', date) AS date, {_ohlcv("c_1h", "date")} GROUP BY 1, 2),
{_fill_sql("c_" + tf, "up_" + tf, tf)}""")
    union = " UNION ALL ".join(f"SELECT * FROM c_{tf}" for tf in LADDER)
    return ",".join(parts) + f",\nmt AS ({union})"


def sql_daily() -> str:
    """CTEs `raw_d` and `d` over `orders`."""
    return f"""
raw_d AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS date,
         first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2),{_fill_sql("d", "raw_d", "1D")}"""


SQL_SHIPPED = """
shipped AS (
  SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS date, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

SQL_LADDER = """
ladder AS (SELECT * FROM (VALUES ('1min', 1, 0), ('5min', 5, 1), ('15min', 15, 2), ('1h', 60, 3), ('4h', 240, 4),
  ('1D', 1440, 5), ('1W', 10080, 6), ('1M', 43200, 7), ('4M', 172800, 8), ('1Y', 525600, 9)) t(timeframe, minutes, rank))"""


def sql_ewm(name: str, source: str, value: str, alpha: float, least: int, out: str) -> str:
    """CTE `name`: `source` with the adjusted exponential mean of `value`, weights taken from the bar distance."""
    return f"""
{name} AS (
  SELECT s.*, e.v AS {out} FROM {source} s LEFT JOIN (
    SELECT a.symbol, a.bar, CASE WHEN count(b.{value}) >= {least} THEN
             sum(b.{value} * pow({1 - alpha!r}, a.bar - b.bar))
             / sum(CASE WHEN b.{value} IS NOT NULL THEN pow({1 - alpha!r}, a.bar - b.bar) END) END AS v
    FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.bar <= a.bar GROUP BY 1, 2) e
  ON s.symbol = e.symbol AND s.bar = e.bar)"""


def sql_atr(name: str, source: str, length: int, out: str = "atr") -> str:
    """CTEs `<name>_tr` and `name`: `source` with its ATR."""
    return f"""
{name}_tr AS (
  SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS prev FROM {source})),
{sql_ewm(name, name + "_tr", "tr", 1.0 / length, length, out)}"""
