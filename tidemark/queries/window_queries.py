"""Frames over candles: smoothing, rolling statistics, extremes, shifts, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import windows as wf
from tidemark.operators.blocks import filled, framed, numbered, running
from tidemark.operators.smoothing import add_atr, add_ewm, add_rma, ema_alpha, rolling_std, sma
from tidemark.queries import query
from tidemark.queries.views import candles, daily, daily_raw, r6, s6, sql_atr, sql_candles, sql_daily, sql_ewm

KEY = ["symbol", "date"]
W = "PARTITION BY symbol ORDER BY date"


@query("rma_volume", f"""WITH {sql_candles()}, {sql_ewm("e", "c_1h", "volume", 1 / 14, 14, "rma")}
SELECT symbol, date, {s6("rma", "rma")} FROM e""")
def rma_volume(spark, sf):
    return add_rma(candles(spark, sf), "volume", 14, "rma").select(*KEY, r6("rma").alias("rma"))


@query("atr", f"""WITH {sql_candles()}, {sql_atr("a", "c_1h", 14)}
SELECT symbol, date, {s6("atr", "atr")} FROM a""")
def atr(spark, sf):
    return add_atr(candles(spark, sf), 14).select(*KEY, r6("atr").alias("atr"))


@query("atr_daily", f"""WITH {sql_daily()}, {sql_atr("a", "d", 20)}
SELECT symbol, date, round(atr, 4) + 0.0 AS atr FROM a""")
def atr_daily(spark, sf):
    return add_atr(daily(spark, sf), 20).select(*KEY, (F.round("atr", 4) + F.lit(0.0)).alias("atr"))


@query("ema", f"""WITH {sql_candles()}, {sql_ewm("e", "c_1h", "close", 2 / 21, 20, "ema")}
SELECT symbol, date, {s6("ema", "ema")} FROM e""")
def ema(spark, sf):
    out = add_ewm(candles(spark, sf), {"ema": (F.col("close"), 20)}, ema_alpha(20))
    return out.select(*KEY, r6("ema").alias("ema"))


def _framed(name, before=0, after=0):
    def run(source, columns):
        return framed(source, lambda rows, w: rows.withColumns(columns(w)), before=before, after=after)

    return run


@query("sma", f"""WITH {sql_candles()}
SELECT symbol, date, {s6("CASE WHEN count(*) OVER f = 20 THEN avg(close) OVER f END", "sma")}
FROM c_1h WINDOW f AS ({W} ROWS 19 PRECEDING)""")
def sma_query(spark, sf):
    out = _framed("sma", 19)(candles(spark, sf), lambda w: {"sma": sma(F.col("close"), w, 20)})
    return out.select(*KEY, r6("sma").alias("sma"))


@query("rolling_std", f"""WITH {sql_candles()}
SELECT symbol, date, {s6("CASE WHEN count(*) OVER f = 20 THEN stddev_samp(close) OVER f END", "std_sample")},
  {s6("CASE WHEN count(*) OVER f = 20 THEN stddev_pop(close) OVER f END", "std_population")}
FROM c_1h WINDOW f AS ({W} ROWS 19 PRECEDING)""")
def rolling_std_query(spark, sf):
    out = _framed("std", 19)(
        candles(spark, sf),
        lambda w: {
            "std_sample": rolling_std(F.col("close"), w, 20),
            "std_population": rolling_std(F.col("close"), w, 20, population=True),
        },
    )
    return out.select(*KEY, r6("std_sample").alias("std_sample"), r6("std_population").alias("std_population"))


@query("rolling_extremes_forward", f"""WITH {sql_candles()}
SELECT symbol, date, max(high) OVER f AS max_high, min(low) OVER f AS min_low
FROM c_1h WINDOW f AS ({W} ROWS BETWEEN 3 FOLLOWING AND 12 FOLLOWING)""")
def rolling_extremes_forward(spark, sf):
    return _framed("x", 0, 12)(
        candles(spark, sf),
        lambda w: {"max_high": wf.frame_max("high", w, 3, 12), "min_low": wf.frame_min("low", w, 3, 12)},
    ).select(*KEY, "max_high", "min_low")


@query("rolling_argmax", f"""WITH {sql_candles()},
e AS (SELECT symbol, date, bar, list(high) OVER f AS h, list(low) OVER f AS l FROM c_1h
      WINDOW f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
SELECT symbol, date, CAST(list_position(h, list_max(h)) - 1 AS BIGINT) AS high_at,
  CAST(list_position(l, list_min(l)) - 1 AS BIGINT) AS low_at FROM e WHERE len(h) = 12""")
def rolling_argmax(spark, sf):
    def columns(w):
        return {
            "high_at": wf.frame_argmax("high", w, 1, 12),
            "low_at": wf.frame_argmin("low", w, 1, 12),
            "_all": wf.full(F.col("high"), w, 1, 12),
        }

    return _framed("a", 0, 12)(candles(spark, sf), columns).where("_all").select(*KEY, "high_at", "low_at")


@query("lag_lead", f"""WITH {sql_candles()}
SELECT symbol, date, lag(close) OVER w AS previous_close, lead(open, 2) OVER w AS open_in_two
FROM c_1h WINDOW w AS ({W})""")
def lag_lead(spark, sf):
    return _framed("l", 1, 2)(
        candles(spark, sf),
        lambda w: {"previous_close": F.lag("close").over(w), "open_in_two": F.lead("open", 2).over(w)},
    ).select(*KEY, "previous_close", "open_in_two")


@query("horizon_window", f"""WITH {sql_candles()},
e AS (SELECT symbol, date, count(*) OVER f AS n, max(high) OVER f AS best, min(low) OVER f AS worst FROM c_1h
      WINDOW f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING))
SELECT symbol, date, best, worst FROM e WHERE n = 48""")
def horizon_window(spark, sf):
    def columns(w):
        return {
            "best": wf.frame_max("high", w, 1, 48),
            "worst": wf.frame_min("low", w, 1, 48),
            "_all": wf.full(F.col("high"), w, 1, 48),
        }

    return _framed("h", 0, 48)(candles(spark, sf), columns).where("_all").select(*KEY, "best", "worst")


@query("forward_backward_fill", f"""WITH {sql_daily()},
grid AS (SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL '1 DAY')) AS date FROM raw_d GROUP BY 1),
g AS (SELECT grid.symbol, grid.date, r.close FROM grid LEFT JOIN raw_d r USING (symbol, date))
SELECT symbol, date, last_value(close IGNORE NULLS) OVER ({W}) AS forward,
  first_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM g""")
def forward_backward_fill(spark, sf):
    real = daily_raw(spark, sf).select(*KEY, F.col("close").alias("forward"), F.col("close").alias("backward"))
    days = daily(spark, sf).select(*KEY).join(real, KEY, "left")
    return filled(filled(days, ["forward"], ["symbol"]), ["backward"], ["symbol"], forward=False)


@query("prefix_suffix_extremes", f"""WITH {sql_candles()}
SELECT symbol, date, max(high) OVER ({W}) AS highest_so_far, min(low) OVER ({W}) AS lowest_so_far,
  max(high) OVER (PARTITION BY symbol ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_later
FROM c_1h""")
def prefix_suffix_extremes(spark, sf):
    out = running(
        candles(spark, sf), {"highest_so_far": ("max", "high"), "lowest_so_far": ("min", "low")}, block_s=86_400 * 5
    )
    out = running(out, {"highest_later": ("max", "high")}, forward=False, inclusive=False, block_s=86_400 * 5)
    return out.select(*KEY, "highest_so_far", "lowest_so_far", "highest_later")


@query("tops_mean", f"""WITH {sql_candles()},
e AS (SELECT symbol, date, list(low) OVER f AS l, list(high) OVER f AS h FROM c_1h WINDOW f AS ({W} ROWS 19 PRECEDING))
SELECT symbol, date, {s6("CASE WHEN len(l) = 20 THEN list_avg(list_sort(l)[1:3]) END", "low_mean")},
  {s6("CASE WHEN len(h) = 20 THEN list_avg(list_reverse_sort(h)[1:3]) END", "high_mean")} FROM e""")
def tops_mean(spark, sf):
    return _framed("t", 19)(
        candles(spark, sf),
        lambda w: {
            "low_mean": wf.tops_mean("low", w, 20, 0.12, largest=False),
            "high_mean": wf.tops_mean("high", w, 20, 0.12, largest=True),
        },
    ).select(*KEY, r6("low_mean").alias("low_mean"), r6("high_mean").alias("high_mean"))


@query("regression_slope", f"""WITH {sql_candles()}
SELECT symbol, date, {s6("CASE WHEN count(*) OVER f = 6 THEN regr_slope(close, bar) OVER f END", "slope")}
FROM c_1h WINDOW f AS ({W} ROWS 5 PRECEDING)""")
def regression_slope(spark, sf):
    out = _framed("r", 5)(candles(spark, sf), lambda w: {"slope": wf.slope("close", w, 6)})
    return out.select(*KEY, r6("slope").alias("slope"))


@query("row_numbers", f"""WITH {sql_daily()}
SELECT symbol, date, row_number() OVER ({W}) - 1 AS n FROM raw_d""")
def row_numbers(spark, sf):
    return numbered(daily_raw(spark, sf).drop("bar"), name="n", block_s=86_400 * 100).select(*KEY, "n")


@query("window_gather", f"""WITH {sql_candles()},
e AS (SELECT symbol, date, list(close) OVER f AS x FROM c_1h WINDOW f AS ({W} ROWS 7 PRECEDING))
SELECT symbol, date, unnest(generate_series(1, 8)) AS position, unnest(x) AS close FROM e WHERE len(x) = 8""")
def window_gather(spark, sf):
    out = _framed("g", 7)(candles(spark, sf), lambda w: {"x": wf.frame_array("close", w, -7, 0)})
    rows = out.where(F.size("x") == 8).select(*KEY, F.posexplode("x").alias("position", "close"))
    return rows.select(*KEY, (F.col("position") + 1).cast("long").alias("position"), "close")
