"""Candle features, labels, profit chain, splits and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.smoothing import add_atr
from tidemark.plans import features as ft
from tidemark.plans import labels as lb
from tidemark.plans import profit as pf
from tidemark.queries import query
from tidemark.queries.views import (
    candles,
    daily_raw,
    r6,
    s6,
    sql_atr,
    sql_candles,
    sql_daily,
    sql_ewm,
    sql_stacked,
    stacked,
)
from tidemark.session import staged

KEY = ["symbol", "date"]
W = "PARTITION BY symbol ORDER BY date"
EPS = "2.220446049250313e-16"


def _rounded(df, *names):
    return df.select(*KEY, *[r6(n).alias(n) for n in names])


@query("relative_candle", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}
SELECT symbol, date, {s6("close / nullif(atr, 0)", "rel_close")}, {s6("(high - close) / nullif(atr, 0)", "rel_high_close")},
  {s6("(close - low) / nullif(atr, 0)", "rel_close_low")}, {s6("(open - prev) / nullif(atr, 0)", "open_gap")},
  {s6("(high - low) / nullif(atr, 0)", "rel_candle_height")} FROM a""")
def relative_candle(spark, sf):
    return _rounded(
        ft.add_relative_candle(candles(spark, sf), 14),
        "rel_close", "rel_high_close", "rel_close_low", "open_gap", "rel_candle_height",
    )


@query("volume_over_rma", f"""WITH {sql_candles()}, {sql_ewm("e", "c_1h", "volume", 1 / 14, 14, "rma")}
SELECT symbol, date, {s6("volume / nullif(rma, 0)", "volume_atr")} FROM e""")
def volume_over_rma(spark, sf):
    return _rounded(ft.add_volume_rma(candles(spark, sf)), "volume_atr")


@query("log_sma_volume", f"""WITH {sql_candles()},
m AS (SELECT *, count(*) OVER f AS n, avg(volume) OVER f AS m FROM c_1h WINDOW f AS ({W} ROWS 23 PRECEDING))
SELECT symbol, date, {s6(f"CASE WHEN n = 24 THEN ln((volume + {EPS}) / (m + {EPS})) END", "log_volume_sma_ratio")} FROM m""")
def log_sma_volume(spark, sf):
    return _rounded(ft.add_log_sma_volume(candles(spark, sf), 24), "log_volume_sma_ratio")


def _mt_volume_sql(tf):
    return (
        f"{sql_ewm('v_' + tf, 'c_' + tf, 'volume', 1 / 14, 14, 'rma')}"
    )


@query("volume_rma_by_timeframe", f"""WITH {sql_stacked()}, {_mt_volume_sql("1h")}, {_mt_volume_sql("4h")}, {_mt_volume_sql("1D")},
{_mt_volume_sql("1W")}, u AS (SELECT * FROM v_1h UNION ALL SELECT * FROM v_4h UNION ALL SELECT * FROM v_1D UNION ALL SELECT * FROM v_1W)
SELECT symbol, timeframe, date, {s6("volume / nullif(rma, 0)", "volume_rma")} FROM u""")
def volume_rma_by_timeframe(spark, sf):
    out = ft.add_volume_rma(stacked(spark, sf), out="volume_rma")
    return out.select("symbol", "timeframe", "date", r6("volume_rma").alias("volume_rma"))


@query("candles_with_atr", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {sql_ewm("e", "a", "volume", 1 / 14, 14, "rma")}
SELECT symbol, date, close, {s6("atr", "atr")}, {s6("volume / nullif(rma, 0)", "volume_rma")} FROM e
WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND atr IS NOT NULL AND rma > 0""")
def candles_with_atr(spark, sf):
    out = ft.candles_with_atr(candles(spark, sf), "2024-01-05", "2024-01-20", 14)
    return out.select(*KEY, "close", r6("atr").alias("atr"), r6("volume_rma").alias("volume_rma"))


def _labels_sql(shift):
    n = 12
    f = f"({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    return f"""WITH {sql_stacked()}, {sql_atr("floor4", "c_4h", 14)},
h AS (SELECT symbol, date, lead(low) OVER ({W}) AS el, lead(high) OVER ({W}) AS es,
        list(high) OVER {f} AS hs, list(low) OVER {f} AS ls FROM c_1h),
x AS (SELECT *, list_max(hs) AS top, list_min(ls) AS bottom,
        list_min(ls[1:list_position(hs, list_max(hs))]) AS worst_low,
        list_max(hs[1:list_position(ls, list_min(ls))]) AS worst_high FROM h WHERE len(hs) = {n}),
fl AS (SELECT symbol, date, atr FROM floor4 WHERE atr IS NOT NULL),
j AS (SELECT x.*, fl.atr FROM x ASOF LEFT JOIN fl
      ON x.symbol = fl.symbol AND fl.date <= x.date - INTERVAL '{shift} HOUR'),
m AS (SELECT *, greatest(0.0, top - el) AS ml, greatest(0.0, es - bottom) AS ms,
        CASE WHEN atr IS NOT NULL THEN greatest(0.0, el - worst_low, atr) END AS al,
        CASE WHEN atr IS NOT NULL THEN greatest(0.0, worst_high - es, atr) END AS as_ FROM j),
o AS (SELECT *, ml / al >= ms / as_ AS is_long FROM m),
r AS (SELECT symbol, date, CASE WHEN atr IS NOT NULL THEN CASE WHEN is_long THEN ml ELSE ms END END AS mfe,
        CASE WHEN is_long THEN al ELSE as_ END AS mae,
        CASE WHEN greatest(ml / al, ms / as_) > 1.5 THEN CASE WHEN is_long THEN 'long' ELSE 'short' END ELSE 'none' END AS action
      FROM o)
SELECT symbol, date, {s6("mfe", "mfe")}, action,
  {s6(f"CASE WHEN mae IS NOT NULL THEN least(greatest(mae / (mfe - mae + {EPS}), 0.0), {1 / 1.5!r}) END", "rer")} FROM r"""


def _labels(spark, sf, as_reference):
    mt = staged(stacked(spark, sf))
    out = lb.excursion_labels(
        mt.where("timeframe = '1h'"), mt.where("timeframe = '4h'"), "1h", "4h",
        horizon=12, floor_length=14, gate=1.5, as_reference=as_reference,
    )
    return out.select(*KEY, r6("mfe").alias("mfe"), "action", r6("rer").alias("rer"))


@query("excursion_labels", _labels_sql(3))
def excursion_labels(spark, sf):
    return _labels(spark, sf, False)


@query("excursion_labels_start_matched", _labels_sql(0))
def excursion_labels_start_matched(spark, sf):
    return _labels(spark, sf, True)


@query("time_split", f"""WITH {sql_candles()},
n AS (SELECT *, row_number() OVER ({W}) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM c_1h)
SELECT symbol, date, CASE WHEN k > c - greatest(1, floor(c * 0.1)) THEN 'validation' ELSE 'train' END AS split FROM n""")
def time_split(spark, sf):
    return lb.split_by_time(candles(spark, sf)).select(*KEY, "split")


@query("next_bar_targets", f"""WITH {sql_candles()},
n AS (SELECT symbol, date, lead(close - open) OVER ({W}) AS target, lead(close) OVER ({W}) AS target_next_close FROM c_1h)
SELECT symbol, date, {s6("target", "target")}, CASE WHEN target > 0 THEN 1 ELSE 0 END AS target_class, target_next_close
FROM n WHERE target IS NOT NULL""")
def next_bar_targets(spark, sf):
    out = lb.next_bar_targets(candles(spark, sf))
    return out.select(*KEY, r6("target").alias("target"), "target_class", "target_next_close")


@query("supervised_pairs", f"""WITH {sql_candles()},
p AS (SELECT symbol, date, close AS y, list(close) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS x FROM c_1h)
SELECT symbol, date, y, x[1] AS x_first, x[6] AS x_last, {s6("list_sum(x)", "x_sum")} FROM p WHERE len(x) = 6""")
def supervised_pairs(spark, sf):
    out = lb.supervised_pairs(candles(spark, sf), 6)
    return out.select(
        *KEY, "y", F.col("x")[0].alias("x_first"), F.col("x")[5].alias("x_last"),
        r6(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("x_sum"),
    )


# --- profit chain: horizon 10, delay 2, window 8, 4 sub-horizons -------------------------------------------
H, D, Q = 10, 2, 4
WIN = H - D


def _frame(a, b):
    return f"({W} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


SQL_EXTREMES = f"""
b0 AS (SELECT *, list(high) OVER ({W} ROWS BETWEEN CURRENT ROW AND {D - 1} FOLLOWING) AS dh,
         list(low) OVER ({W} ROWS BETWEEN CURRENT ROW AND {D - 1} FOLLOWING) AS dl,
         list(high) OVER {_frame(H - WIN + 1, H)} AS hh, list(low) OVER {_frame(H - WIN + 1, H)} AS ll,
         list(high) OVER {_frame(1, WIN)} AS qh, list(low) OVER {_frame(1, WIN)} AS ql FROM a),
b AS (SELECT *, CASE WHEN len(dh) = {D} THEN list_max(dh) END AS worst_long_open,
        CASE WHEN len(dl) = {D} THEN list_min(dl) END AS worst_short_open,
        CASE WHEN len(hh) = {WIN} THEN list_max(hh) END AS max_high, CASE WHEN len(ll) = {WIN} THEN list_min(ll) END AS min_low,
        CASE WHEN len(hh) = {WIN} THEN list_position(hh, list_max(hh)) - 1 + {D} + 0.0 END AS max_high_distance,
        CASE WHEN len(ll) = {WIN} THEN list_position(ll, list_min(ll)) - 1 + {D} + 0.0 END AS min_low_distance FROM b0)"""


def _q(i):
    return int(i * WIN / Q)


SQL_DRAWDOWN = f"""
dd0 AS (SELECT *, atr IS NOT NULL AND len(qh) = {WIN} AND max_high IS NOT NULL AS ok,
          [{", ".join(f"list_min(ql[1:{_q(i)}])" for i in range(1, Q + 1))}] AS lows,
          [{", ".join(f"list_max(qh[1:{_q(i)}])" for i in range(1, Q + 1))}] AS highs,
          CASE WHEN atr IS NOT NULL AND len(qh) = {WIN} AND max_high IS NOT NULL THEN max_high_distance / {H / Q} END AS max_high_quantile,
          CASE WHEN atr IS NOT NULL AND len(qh) = {WIN} AND max_high IS NOT NULL THEN min_low_distance / {H / Q} END AS min_low_quantile
        FROM b),
dd1 AS (SELECT *, worst_long_open - lows[CAST(floor(max_high_quantile) AS INT) + 1] AS al,
          highs[CAST(floor(min_low_quantile) AS INT) + 1] - worst_short_open AS as_ FROM dd0),
dd AS (SELECT *, al / nullif(atr, 0) AS long_drawdown, as_ / nullif(atr, 0) AS short_drawdown FROM dd1)"""


@query("horizon_extremes", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {SQL_EXTREMES}
SELECT symbol, date, worst_long_open, worst_short_open, max_high, min_low, max_high_distance, min_low_distance FROM b""")
def horizon_extremes(spark, sf):
    return pf.add_horizon_extremes(candles(spark, sf), H, D, WIN).select(
        *KEY, "worst_long_open", "worst_short_open", "max_high", "min_low", "max_high_distance", "min_low_distance"
    )


def _sub_sql():
    parts = []
    for i in range(1, Q + 1):
        n = _q(i)
        parts.append(f"CASE WHEN len(qh) >= {n} THEN list_max(qh[1:{n}]) END AS q{i}_max_high")
        parts.append(f"CASE WHEN len(ql) >= {n} THEN list_min(ql[1:{n}]) END AS q{i}_min_low")
        parts.append(
            f"CASE WHEN len(qh) >= {n} THEN list_position(qh[1:{n}], list_max(qh[1:{n}])) - 1.0 END AS q{i}_max_high_distance"
        )
        parts.append(
            f"CASE WHEN len(ql) >= {n} THEN list_position(ql[1:{n}], list_min(ql[1:{n}])) - 1.0 END AS q{i}_min_low_distance"
        )
    return ", ".join(parts)


@query("sub_horizon_extremes", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {SQL_EXTREMES}
SELECT symbol, date, {_sub_sql()} FROM b""")
def sub_horizon_extremes(spark, sf):
    out = pf.add_sub_horizons(candles(spark, sf), WIN, Q)
    return out.select(*KEY, *[c for c in out.columns if c.startswith("q")])


def _drawdowns(spark, sf):
    out = add_atr(candles(spark, sf), 14)
    return pf.add_drawdowns(pf.add_sub_horizons(pf.add_horizon_extremes(out, H, D, WIN), WIN, Q), H, Q)


@query("sub_horizon_drawdown", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {SQL_EXTREMES}, {SQL_DRAWDOWN}
SELECT symbol, date, {s6("max_high_quantile", "max_high_quantile")}, {s6("min_low_quantile", "min_low_quantile")},
  {s6("long_drawdown", "long_drawdown")}, {s6("short_drawdown", "short_drawdown")} FROM dd""")
def sub_horizon_drawdown(spark, sf):
    return _rounded(_drawdowns(spark, sf), "max_high_quantile", "min_low_quantile", "long_drawdown", "short_drawdown")


@query("stop_distance", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {SQL_EXTREMES}, {SQL_DRAWDOWN}
SELECT symbol, date, {s6("CASE WHEN long_drawdown IS NOT NULL THEN greatest(1.0, long_drawdown) END", "long_sl_distance")},
  {s6("CASE WHEN short_drawdown IS NOT NULL THEN greatest(1.0, short_drawdown) END", "short_sl_distance")} FROM dd""")
def stop_distance(spark, sf):
    return _rounded(pf.add_stop_distance(_drawdowns(spark, sf)), "long_sl_distance", "short_sl_distance")


FEE, RISK, RATE = 0.005, 2.0, (0.10 / 365) / 24


def _profit_sql(side, gain, distance):
    return f"""
p_{side} AS (SELECT *, ({gain}) / nullif(atr, 0) - {distance} * {RATE!r} - {FEE} AS w_{side} FROM {{source}}),
r_{side} AS (SELECT *, {side}_drawdown / nullif(w_{side}, 0) AS k_{side},
    coalesce(w_{side} <= 0 OR {side}_drawdown / nullif(w_{side}, 0) > {RISK}, false) AS lost_{side} FROM p_{side}),
s_{side} AS (SELECT *, CASE WHEN lost_{side} THEN 1.0 ELSE k_{side} END AS {side}_risk,
    CASE WHEN lost_{side} THEN 0.0 ELSE (1 - coalesce(k_{side}, 1.0)) * coalesce(w_{side}, 0.0)
      / CASE WHEN {side}_drawdown IS NOT NULL THEN greatest(1.0, {side}_drawdown) END END AS {side}_signal FROM r_{side})"""


SQL_PROFIT = (
    _profit_sql("long", "max_high - worst_long_open", "max_high_distance").format(source="dd")
    + ","
    + _profit_sql("short", "worst_short_open - min_low", "min_low_distance").format(source="s_long")
)
PROFIT_COLUMNS = ["weighted_long_profit", "weighted_short_profit", "long_risk", "short_risk", "long_signal", "short_signal"]
SQL_PROFIT_SELECT = f"""SELECT symbol, date, {s6("w_long", "weighted_long_profit")}, {s6("w_short", "weighted_short_profit")},
  {s6("long_risk", "long_risk")}, {s6("short_risk", "short_risk")}, {s6("long_signal", "long_signal")},
  {s6("short_signal", "short_signal")}"""


@query("profit_and_loss", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {SQL_EXTREMES}, {SQL_DRAWDOWN}, {SQL_PROFIT}
{SQL_PROFIT_SELECT} FROM s_short""")
def profit_and_loss(spark, sf):
    return _rounded(pf.add_profit(pf.add_stop_distance(_drawdowns(spark, sf)), RATE, FEE, RISK), *PROFIT_COLUMNS)


@query("profit_chain", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {SQL_EXTREMES}, {SQL_DRAWDOWN}, {SQL_PROFIT}
{SQL_PROFIT_SELECT}, max_high_distance * 60 AS long_distance_minutes, min_low_distance * 60 AS short_distance_minutes
FROM s_short""")
def profit_chain(spark, sf):
    out = pf.add_long_short_profit(
        add_atr(candles(spark, sf), 14), horizon=H, delay=D, quantiles=Q, max_risk=RISK, trigger_tf="1h"
    )
    return out.select(
        *KEY, *[r6(c).alias(c) for c in PROFIT_COLUMNS], "long_distance_minutes", "short_distance_minutes"
    )


@query("tops_stop_loss", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)},
e AS (SELECT *, list(low) OVER f AS l, list(high) OVER f AS h FROM a WINDOW f AS ({W} ROWS 19 PRECEDING)),
m AS (SELECT *, CASE WHEN len(l) = 20 THEN list_avg(list_sort(l)[1:3]) END AS lo,
        CASE WHEN len(h) = 20 THEN list_avg(list_reverse_sort(h)[1:3]) END AS hi FROM e)
SELECT symbol, date, {s6("CASE WHEN abs(lo - low) < atr * 2 THEN low - atr * 2 ELSE lo END", "long_sl")},
  {s6("CASE WHEN abs(hi - high) < atr * 2 THEN high + atr * 2 ELSE hi END", "short_sl")} FROM m""")
def tops_stop_loss(spark, sf):
    return _rounded(pf.add_tops_stop_loss(add_atr(candles(spark, sf), 14), 20, 0.12), "long_sl", "short_sl")


@query("step_drawdowns", f"""WITH {sql_candles()},
s AS (SELECT *, greatest(0.0, high - lead(low) OVER ({W})) AS fall, greatest(0.0, lead(high) OVER ({W}) - low) AS rise FROM c_1h),
f AS (SELECT *, list(high) OVER {_frame(1, 12)} AS hs, list(low) OVER {_frame(1, 12)} AS ls,
        list(fall) OVER ({W} ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS falls,
        list(rise) OVER ({W} ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS rises FROM s),
n AS (SELECT *, list_position(hs, list_max(hs)) - 1 AS cl, list_position(ls, list_min(ls)) - 1 AS cs FROM f WHERE len(hs) = 12),
d AS (SELECT *, CASE WHEN cl = 0 THEN 0.0 ELSE list_sum(falls[1:cl]) END AS dl, CASE WHEN cs = 0 THEN 0.0 ELSE list_sum(rises[1:cs]) END AS ds FROM n)
SELECT symbol, date, CAST(cl AS BIGINT) AS count_long_drawdown, CAST(cs AS BIGINT) AS count_short_drawdown,
  {s6("dl", "max_long_drawdown")}, {s6("ds", "max_short_drawdown")},
  {s6("(1 - cl / 12.0) * dl", "relative_long_drawdown")}, {s6("(1 - cs / 12.0) * ds", "relative_short_drawdown")},
  {s6("list_max(hs) - high - (1 - cl / 12.0) * dl", "effective_long_power")},
  {s6("low - list_min(ls) - (1 - cs / 12.0) * ds", "effective_short_power")} FROM d""")
def step_drawdowns(spark, sf):
    out = pf.add_step_drawdowns(candles(spark, sf), 12)
    names = [f"{p}_{s}_{x}" for s in ("long", "short") for p, x in
             (("max", "drawdown"), ("relative", "drawdown"), ("effective", "power"))]
    return out.select(*KEY, "count_long_drawdown", "count_short_drawdown", *[r6(n).alias(n) for n in names])


@query("drop_sub_horizon_columns", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}, {SQL_EXTREMES}
SELECT symbol, date, max_high FROM b""")
def drop_sub_horizon_columns(spark, sf):
    wide = pf.add_sub_horizons(pf.add_horizon_extremes(candles(spark, sf), H, D, WIN), WIN, Q)
    return pf.drop_sub_horizons(wide).select(*KEY, "max_high")
