"""Classic indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import indicators as ind
from tidemark.queries import query
from tidemark.queries.views import LADDER, candles, r6, s6, sql_candles, sql_ewm, stacked, sql_stacked
from tidemark.session import staged

KEY = ["symbol", "date"]
W = "PARTITION BY symbol ORDER BY date"
TP = "(high + low + close) / 3"


def _rounded(df, *names):
    return df.select(*KEY, *[r6(n).alias(n) for n in names])


SQL_OBV = f"""
obv AS (SELECT *, sum(coalesce(sign(close - p), 1) * volume) OVER ({W}) AS obv
  FROM (SELECT *, lag(close) OVER ({W}) AS p FROM c_1h))"""
SQL_CCI = f"""
tp AS (SELECT *, {TP} AS tp FROM c_1h),
tpl AS (SELECT *, list(tp) OVER ({W} ROWS 13 PRECEDING) AS l FROM tp),
cci AS (SELECT *, CASE WHEN len(l) = 14 THEN (tp - list_avg(l))
  / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - list_avg(l)))), 0) END AS cci FROM tpl)"""


def _scaled_sql(c):
    f = f"({W} ROWS 287 PRECEDING)"
    return (
        f"10 * ({c} - avg({c}) OVER {f}) / (3 * CASE WHEN stddev_pop({c}) OVER {f} = 0 THEN 1e-9 "
        f"ELSE stddev_pop({c}) OVER {f} END)"
    )


@query("obv", f"WITH {sql_candles()}, {SQL_OBV} SELECT symbol, date, {s6('obv', 'obv')} FROM obv")
def obv(spark, sf):
    return _rounded(ind.add_obv(candles(spark, sf)), "obv")


@query("cci", f"WITH {sql_candles()}, {SQL_CCI} SELECT symbol, date, {s6('cci', 'cci')} FROM cci")
def cci(spark, sf):
    return _rounded(ind.add_cci(candles(spark, sf)), "cci")


@query("scaled_obv_cci", f"""WITH {sql_candles()}, {SQL_OBV}, {SQL_CCI},
j AS (SELECT o.symbol, o.date, o.obv, c.cci FROM obv o JOIN cci c USING (symbol, date))
SELECT symbol, date, {s6(_scaled_sql("obv"), "sc_obv")}, {s6(_scaled_sql("cci"), "sc_cci")} FROM j""")
def scaled_obv_cci(spark, sf):
    return _rounded(ind.add_classic_indicators(candles(spark, sf)), "sc_obv", "sc_cci")


@query("rsi", f"""WITH {sql_candles()},
s AS (SELECT *, greatest(x, 0 * x) AS up, greatest(-x, 0 * x) AS down
      FROM (SELECT *, close - lag(close) OVER ({W}) AS x FROM c_1h)),
{sql_ewm("g", "s", "up", 1 / 14, 14, "gain")}, {sql_ewm("l", "g", "down", 1 / 14, 14, "loss")}
SELECT symbol, date, {s6("100 * gain / nullif(gain + loss, 0)", "rsi")} FROM l""")
def rsi(spark, sf):
    return _rounded(ind.add_rsi(candles(spark, sf)), "rsi")


@query("mfi", f"""WITH {sql_candles()},
t AS (SELECT *, tp - lag(tp) OVER ({W}) AS x FROM (SELECT *, {TP} AS tp FROM c_1h)),
s AS (SELECT *, CASE WHEN x > 0 THEN tp * volume ELSE 0 END AS up, CASE WHEN x < 0 THEN tp * volume ELSE 0 END AS down
      FROM t),
f AS (SELECT symbol, date, count(*) OVER f AS n, sum(up) OVER f AS u, sum(down) OVER f AS d FROM s
      WINDOW f AS ({W} ROWS 13 PRECEDING))
SELECT symbol, date, {s6("CASE WHEN n = 14 THEN 100 * u / nullif(u + d, 0) END", "mfi")} FROM f""")
def mfi(spark, sf):
    return _rounded(ind.add_mfi(candles(spark, sf)), "mfi")


@query("bollinger_bands", f"""WITH {sql_candles()},
b AS (SELECT symbol, date, count(*) OVER f AS n, avg(close) OVER f AS m, 2 * stddev_pop(close) OVER f AS o FROM c_1h
      WINDOW f AS ({W} ROWS 4 PRECEDING))
SELECT symbol, date, {s6("CASE WHEN n = 5 THEN m END", "bbands_m")}, {s6("CASE WHEN n = 5 THEN m + o END", "bbands_u")},
  {s6("CASE WHEN n = 5 THEN m - o END", "bbands_l")}, {s6("CASE WHEN n = 5 THEN 2 * o END", "bollinger_width")} FROM b""")
def bollinger_bands(spark, sf):
    return _rounded(ind.add_bbands(candles(spark, sf)), "bbands_m", "bbands_u", "bbands_l", "bollinger_width")


def _mid_sql(n):
    f = f"({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(*) OVER {f} = {n} THEN (max(high) OVER {f} + min(low) OVER {f}) / 2 END"


@query("ichimoku", f"""WITH {sql_candles()},
m AS (SELECT *, {_mid_sql(9)} AS c, {_mid_sql(26)} AS b, {_mid_sql(52)} AS s FROM c_1h)
SELECT symbol, date, {s6("c", "ichi_conv")}, {s6("b", "ichi_base")},
  {s6(f"lag((c + b) / 2, 26) OVER ({W})", "ichi_lead_a")}, {s6(f"lag(s, 26) OVER ({W})", "ichi_lead_b")},
  {s6(f"lead(close, 26) OVER ({W})", "ichi_lag")} FROM m""")
def ichimoku(spark, sf):
    return _rounded(
        ind.add_ichimoku(candles(spark, sf)), "ichi_conv", "ichi_base", "ichi_lead_a", "ichi_lead_b", "ichi_lag"
    )


def _full_sql(agg, c, n):
    f = f"({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) OVER {f} = {n} THEN {agg} OVER {f} END"


@query("obv_macd", f"""WITH {sql_candles()}, {SQL_OBV},
a AS (SELECT *, obv - {_full_sql("avg(obv)", "obv", 14)} AS gap, high - low AS spread FROM obv),
b AS (SELECT *, gap / nullif({_full_sql("stddev_samp(gap)", "gap", 28)}, 0)
        * {_full_sql("stddev_samp(spread)", "spread", 28)} AS shadow FROM a),
c AS (SELECT *, CASE WHEN shadow > 0 THEN high + shadow ELSE low + shadow END AS adjusted FROM b),
{sql_ewm("e1", "c", "adjusted", 2 / 13, 12, "fast")}, {sql_ewm("e2", "e1", "adjusted", 2 / 27, 26, "slow")},
m AS (SELECT *, fast - slow AS macd FROM e2), {sql_ewm("e3", "m", "macd", 2 / 10, 9, "signal")}
SELECT symbol, date, {s6("adjusted", "shadow_adjusted_obv")}, {s6("macd", "macd")}, {s6("signal", "macd_signal")},
  {s6("macd - signal", "macd_histogram")}, {s6(_full_sql("regr_slope(macd, bar)", "macd", 2), "slope")},
  {s6(_full_sql("max(macd)", "macd", 50), "max_upper")}, {s6(_full_sql("min(macd)", "macd", 50), "min_lower")} FROM e3""")
def obv_macd(spark, sf):
    return _rounded(
        ind.add_obv_macd(candles(spark, sf)),
        "shadow_adjusted_obv", "macd", "macd_signal", "macd_histogram", "slope", "max_upper", "min_lower",
    )


PRICES = ["open", "high", "low", "close", "volume"]


def _z_sql() -> str:
    """CTEs `z_<timeframe>` with mean and deviation of every column, and their union `z`."""
    parts = []
    for tf in LADDER:
        n = ind.NORMALIZATION_LENGTH[tf]
        before = ", ".join(f"lag({c}) OVER ({W}) AS pre_{c}" for c in PRICES)
        parts.append(f"p_{tf}_0 AS (SELECT *, {before} FROM c_{tf})")
        for i, c in enumerate(PRICES):
            parts.append(sql_ewm(f"p_{tf}_{i + 1}", f"p_{tf}_{i}", f"pre_{c}", 2 / (n + 1), n, f"mean_{c}"))
        spreads = ", ".join(f"{_full_sql(f'stddev_samp(pre_{c})', f'pre_{c}', n)} AS std_{c}" for c in PRICES)
        parts.append(f"z_{tf} AS (SELECT *, {spreads} FROM p_{tf}_{len(PRICES)})")
    return ",".join(parts) + f", z AS ({' UNION ALL '.join(f'SELECT * FROM z_{tf}' for tf in LADDER)})"


def _z_encoded(spark, sf):
    mt = staged(stacked(spark, sf))
    return [ind.z_encode(mt.where(F.col("timeframe") == tf), tf, PRICES) for tf in LADDER]


Z_COLUMNS = [f"{kind}_{c}" for c in PRICES for kind in ("mean", "std", "n")]


def _z_column(name: str) -> str:
    c = name.split("_")[1]
    return s6(f"({c} - mean_{c}) / nullif(std_{c}, 0)" if name.startswith("n_") else name, name)


@query("z_encode", f"""WITH {sql_stacked()}, {_z_sql()}
SELECT symbol, timeframe, date, {", ".join(_z_column(c) for c in Z_COLUMNS)} FROM z""")
def z_encode(spark, sf):
    parts = [df.select(*KEY, "timeframe", *[r6(c).alias(c) for c in Z_COLUMNS]) for df in _z_encoded(spark, sf)]
    return reduce(DataFrame.unionByName, parts)


@query("z_decode", f"""WITH {sql_stacked()}, {_z_sql()}
SELECT symbol, timeframe, date, {", ".join(s6(f"CASE WHEN std_{c} <> 0 THEN {c} END", c) for c in PRICES)} FROM z WHERE std_close <> 0""")
def z_decode(spark, sf):
    parts = [
        ind.z_decode(df.drop(*PRICES), PRICES).where("close is not null").select(*KEY, "timeframe", *[r6(c).alias(c) for c in PRICES])
        for df in _z_encoded(spark, sf)
    ]
    return reduce(DataFrame.unionByName, parts)
